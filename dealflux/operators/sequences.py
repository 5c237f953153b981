"""Event order: next events, n-grams, flows, transition probabilities and funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators import filters
from dealflux.operators.projections import daytime
from dealflux.plans import kernels as K
from dealflux.plans.ordered import following, neighbours, preceding

ORDER = ("event_time", "event_id")


def next_event(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Each event with the next one of its session."""
    return following(df, [session], ORDER, ["event_type"])


def prev_event(df: DataFrame, session: str = "session_id", default: str = "START") -> DataFrame:
    """Each event with the previous one of its session, ``default`` for the first."""
    wide = preceding(df, [session], ORDER, ["event_type"])
    return wide.withColumn("prev_event_type", F.coalesce("prev_event_type", F.lit(default)))


def first_events(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions counted by their first event."""
    firsts = K.aggregate_by(df, [session], event_type=F.min_by("event_type", F.struct(*ORDER)))
    return firsts.groupBy("event_type").agg(F.count(F.lit(1)).alias("sessions"))


def seconds_since_previous(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Each event with the seconds since the user's previous one."""
    wide = preceding(df, [user], ORDER, [ORDER[0]])
    return wide.withColumn("secs_since_prev", C.seconds_between(f"prev_{ORDER[0]}", ORDER[0])).drop(f"prev_{ORDER[0]}")


def transitions(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Counts of event -> next event within sessions."""
    pairs = K.present(next_event(df, session), "next_event_type")
    return pairs.groupBy("event_type", "next_event_type").agg(F.count(F.lit(1)).alias("n"))


def user_pairs(df: DataFrame, top: int = 10, user: str = "user_id", *, include_terminal: bool = True) -> DataFrame:
    """Most frequent consecutive pairs of a user's timeline; the last event pairs with "nan"."""
    wide = following(df, [user], ORDER, ["event_type"])
    if not include_terminal:
        wide = K.present(wide, "next_event_type")
    second = F.coalesce("next_event_type", F.lit("nan"))
    pairs = wide.groupBy(F.concat_ws(" -> ", "event_type", second).alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    return K.top_k(pairs, top, F.desc("n"), F.asc("pair"))


def markov(df: DataFrame, session: str = "session_id", *, min_prob: float = 0.0, include_lowest: bool = False) -> DataFrame:
    """Transition count, probability and mean seconds between (event, time of day) states.

    ``src`` and ``dst`` are the states' names, ``src_event`` and ``dst_event`` their events, whatever characters they have.
    """
    state = F.concat_ws("|", "event_type", daytime(F.hour(ORDER[0]), include_lowest=include_lowest))
    steps = following(df.withColumn("state", state), [session], ORDER, ["state", "event_type", ORDER[0]])
    counted = (
        K.present(steps, "next_state")
        .groupBy(F.col("state").alias("src"), F.col("next_state").alias("dst"), F.col("event_type").alias("src_event"), F.col("next_event_type").alias("dst_event"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(C.seconds_between(ORDER[0], f"next_{ORDER[0]}")).alias("avg_secs"))
    )
    edges = K.share_of(counted, "n", ["src"], "prob").withColumn("prob", F.col("prob") / 100.0)
    return edges.where(F.col("prob") > min_prob) if min_prob else edges


def markov_predict(edges: DataFrame, last: DataFrame, top: int = 5) -> DataFrame:
    """Most probable next events for each last event, over all its time-of-day contexts.

    ``last`` holds one row per case (``case_id``, ``event_type``). Answers are ranked once per
    distinct event and then joined to the cases, so the work does not grow with repeated events.
    """
    by_event = edges.groupBy(
        F.col("src_event").alias("event_type"), F.col("dst_event").alias("next_event")
    ).agg(F.sum("n").alias("n"), F.max("prob").alias("max_prob"))
    probable = K.share_of(by_event, "n", ["event_type"], "prob").withColumn("prob", F.col("prob") / 100.0)
    ranked = K.top_per_group(probable, ["event_type"], top, F.desc("prob"), F.asc("next_event"))
    return last.join(ranked, "event_type").select("case_id", "event_type", "rank", "next_event", "prob", "max_prob")


def time_of_day_matrix(df: DataFrame) -> DataFrame:
    """Events by time of day and type, zero-filled (hour 0 lies in no bin)."""
    part = C.bins(F.hour(ORDER[0]), V.DAYTIME_EDGES, V.DAYTIME_LABELS)
    rows = df.select(part.alias("time_of_day"), "event_type")
    return K.crosstab(rows, "event_type", "time_of_day", K.literal_array(V.DAYTIME_LABELS))


def ngrams(df: DataFrame, lengths: Sequence[int] = (2, 3, 4, 5), blacklist: Sequence[str] = (), session: str = "session_id") -> DataFrame:
    """All event n-grams within sessions with their counts."""
    kept = filters.exclude(df, "event_type", blacklist) if blacklist else df
    n = max(lengths)
    wide = neighbours(kept, [session], ORDER, ["event_type"], n=n - 1)
    path = F.concat(F.array("event_type"), F.col("_next.event_type"))
    grams = F.array(*[
        F.when(F.size(path) >= k, F.struct(F.lit(k).alias("length"), F.array_join(F.slice(path, 1, k), V.ARROW).alias("sequence")))
        for k in lengths
    ])
    return (
        wide.select(F.explode(F.array_compact(grams)).alias("_g"))
        .groupBy("_g.length", "_g.sequence")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_ngrams(counts: DataFrame, pairs: int = 20, longer: int = 10) -> DataFrame:
    """The most frequent n-grams per length (more of length 2)."""
    ranked = K.top_per_group(counts, ["length"], max(pairs, longer), F.desc("n"), F.asc("sequence"))
    return ranked.where((F.col("length") == 2) & (F.col("rank") <= pairs) | (F.col("rank") <= longer))


def clean_name(c):
    """Readable event name: separators to spaces, title case."""
    return F.initcap(F.trim(F.regexp_replace(c, "[:_-]+", " ")))


def flow_edges(top: DataFrame) -> DataFrame:
    """Positional flow graph of top n-grams: event at i -> event at i + 1 with summed weight."""
    steps = F.split("sequence", V.ARROW)
    moves = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1),
        lambda i: F.struct(i.alias("position"), F.get(steps, i - 1).alias("source"), F.get(steps, i).alias("target")),
    )
    return (
        top.select("n", F.explode(moves).alias("_m"))
        .groupBy(F.col("_m.position").alias("position"), clean_name(F.col("_m.source")).alias("source"),
                 clean_name(F.col("_m.target")).alias("target"))
        .agg(F.sum("n").alias("weight"))
    )


def funnels(df: DataFrame, steps: Mapping[str, Sequence[str]], *, mode: str = "independent", user: str = "user_id", ts: str = "event_time") -> DataFrame:
    """Users reaching each step of named funnels and the conversion from the step before.

    ``independent`` counts users per step on its own; ``ordered`` counts users whose first times
    of steps 1..k do not decrease. Either way one aggregation per user answers all funnels.
    """
    kinds = sorted({e for s in steps.values() for e in s})
    rows = K.present(df.where(F.col("event_type").isin(*kinds)), user)
    firsts = rows.groupBy(user).agg(*[F.min(F.when(F.col("event_type") == k, F.col(ts))).alias(f"t{i}") for i, k in enumerate(kinds)])
    at = {k: F.col(f"t{i}") for i, k in enumerate(kinds)}
    counts, cells = [], []
    for name, events in steps.items():
        reached = F.lit(True)
        for i, event in enumerate(events):
            here = at[event].isNotNull()
            if mode == "ordered":
                reached = reached & here
                if i:
                    reached = reached & (at[events[i - 1]] <= at[event])
                here = reached
            alias = f"c{len(counts)}"
            counts.append(F.count_if(here).alias(alias))
            before = F.col(f"c{len(counts) - 2}") if i else None
            rate = C.percent(F.col(alias), before) if i else F.lit(100.0)
            cells.append(F.struct(F.lit(name).alias("funnel"), F.lit(i + 1).alias("step"), F.lit(event).alias("event_type"),
                                  F.col(alias).alias("users"), rate.alias("conversion")))
    return firsts.agg(*counts).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def sliding_windows(df: DataFrame, length: int = 3, per_session: int | None = 25, seed: int = 42, session: str = "session_id") -> DataFrame:
    """Windows of ``length`` preceding events with the current one as label.

    At most ``per_session`` windows of a session are kept, picked by a seeded hash.
    """
    wide = neighbours(df, [session], ORDER, ["event_type"], n=length, backwards=True, out="_prev")
    full = wide.where(F.size("_prev") == length).select(
        session, "event_id", F.reverse(F.col("_prev.event_type")).alias("events"), F.col("event_type").alias("label")
    )
    if per_session is None:
        return full
    pick = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("event_id").cast("string")))
    return K.top_per_group(full, [session], per_session, pick, F.col("event_id")).drop("rank")


def next_event_backoff(df: DataFrame, length: int = 3, top: int = 5, session: str = "session_id") -> DataFrame:
    """Next-event table for contexts of 1..length events: (context, next) counts and ranks."""
    wide = neighbours(df, [session], ORDER, ["event_type"], n=length, backwards=True, out="_prev")
    past = F.reverse(F.col("_prev.event_type"))
    contexts = F.transform(
        F.sequence(F.lit(1), F.size("_prev")),
        lambda k: F.struct(k.alias("length"), F.array_join(F.slice(past, -k, k), V.ARROW).alias("context")),
    )
    counted = (
        wide.where(F.size("_prev") > 0)
        .select(F.col("event_type").alias("next_event"), F.explode(contexts).alias("_c"))
        .groupBy("_c.length", "_c.context", "next_event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = K.share_of(counted, "n", ["length", "context"], "prob").withColumn("prob", F.col("prob") / 100.0)
    return K.top_per_group(shares, ["length", "context"], top, F.desc("n"), F.asc("next_event"))


def predict_backoff(table: DataFrame, cases: DataFrame, length: int = 3) -> DataFrame:
    """Ranked next events of each case from its longest known context.

    ``cases`` has ``case_id`` and ``events`` (array, oldest first).
    """
    n = F.least(F.size("events"), F.lit(length))
    contexts = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.struct(k.alias("length"), F.array_join(F.slice(F.col("events"), -k, k), V.ARROW).alias("context")),
    )
    asked = cases.where(F.size("events") > 0).select("case_id", F.explode(contexts).alias("_c")).select("case_id", "_c.*")
    known = table.select("length", "context").distinct()
    best = (
        asked.join(known, ["length", "context"])
        .groupBy("case_id")
        .agg(F.max(F.struct("length", "context")).alias("_b"))
        .select("case_id", "_b.*")
    )
    return best.join(table, ["length", "context"]).select("case_id", "length", "context", "rank", "next_event", "prob")

"""Per-session and per-user summaries of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.operators import filters
from dealflux.plans import kernels as K

TS = "event_time"
ORDER = ("event_time", "event_id")


def session_stats(df: DataFrame, session: str = "session_id", ts: str = TS) -> DataFrame:
    """Events, distinct types, first and last time and minutes of each session."""
    stats = K.aggregate_by(
        df,
        [session],
        events=F.count(F.lit(1)),
        event_types=F.count_distinct("event_type"),
        start_time=F.min(ts),
        end_time=F.max(ts),
    )
    return stats.withColumn("minutes", C.seconds_between("start_time", "end_time") / 60.0)


def session_spans(df: DataFrame, session: str = "session_id", ts: str = TS) -> DataFrame:
    """Events, start, end and duration in seconds of each session."""
    spans = K.aggregate_by(df, [session], events=F.count(F.lit(1)), start_time=F.min(ts), end_time=F.max(ts))
    return spans.withColumn("seconds", C.seconds_between("start_time", "end_time"))


def with_duration(df: DataFrame, session: str = "session_id", ts: str = TS, out: str = "session_duration") -> DataFrame:
    """Each row with its session's duration in seconds.

    Spans are aggregated first and joined back, so a large session is never sorted in one task.
    """
    spans = session_spans(df, session, ts).select(session, F.col("seconds").alias(out))
    return df.join(spans, session)


def stats_summary(df: DataFrame, session: str = "session_id", ts: str = TS) -> DataFrame:
    """Distribution of events and minutes over sessions, one row per measure."""
    stats = session_spans(df, session, ts)
    long = K.unpivot(
        stats.select(F.col("events").cast("double").alias("events"), (F.col("seconds") / 60.0).alias("minutes")),
        [], ["events", "minutes"], "measure", "value",
    )
    return K.describe(long, ["measure"], "value", bounded=True)


def first_last(df: DataFrame, session: str = "session_id", order: Sequence[str] = ORDER) -> DataFrame:
    """First and last event type of each session."""
    at = F.struct(*order)
    return K.aggregate_by(
        df, [session], first_event=F.min_by("event_type", at), last_event=F.max_by("event_type", at)
    )


def first_last_counts(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Ranked first and last events with their share of sessions."""
    long = K.unpivot(first_last(df, session), [], ["first_event", "last_event"], "position", "event_type")
    counts = long.groupBy("position", "event_type").agg(F.count(F.lit(1)).alias("sessions"))
    return K.share_of(counts, "sessions", ["position"], "share")


def entry_exit(df: DataFrame, blacklist: Sequence[str] = (), top: int = 10) -> DataFrame:
    """Most common entry and exit events once the blacklist is removed."""
    kept = filters.exclude(df, "event_type", blacklist) if blacklist else df
    counts = first_last_counts(kept).drop("share")
    return K.top_per_group(counts, ["position"], top, F.desc("sessions"), F.asc("event_type"))


def activity_describe(df: DataFrame, session: str = "session_id", user: str = "user_id", ts: str = TS) -> DataFrame:
    """describe() of events per session, seconds per session, events and sessions per user."""
    per_session = session_spans(df, session, ts)
    per_user = K.aggregate_by(df, [user], events=F.count(F.lit(1)), sessions=F.count_distinct(session))
    named = lambda d, name, c: d.select(F.lit(name).alias("measure"), F.col(c).cast("double").alias("value"))
    long = (
        named(per_session, "events_per_session", "events")
        .unionByName(named(per_session, "session_seconds", "seconds"))
        .unionByName(named(per_user, "events_per_user", "events"))
        .unionByName(named(per_user, "sessions_per_user", "sessions"))
    )
    return K.describe(long, ["measure"], "value", bounded=True)


def duration_by_start(df: DataFrame, session: str = "session_id", ts: str = TS) -> DataFrame:
    """Mean session seconds by start hour, weekday (Monday = 0) and month."""
    spans = session_spans(df, session, ts)
    parts = spans.select(
        F.hour("start_time").alias("hour"), F.weekday("start_time").alias("weekday"),
        F.month("start_time").alias("month"), "seconds",
    )
    long = K.unpivot(parts, ["seconds"], ["hour", "weekday", "month"], "part", "value")
    return long.groupBy("part", "value").agg(F.avg("seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("sessions"))


def sequence_lengths(df: DataFrame, session: str = "session_id") -> DataFrame:
    sizes = K.aggregate_by(df, [session], n=F.count(F.lit(1)))
    return sizes.agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("n").alias("mean_events"),
        F.max("n").alias("max_events"), F.min("n").alias("min_events"),
    )


def short_sessions(df: DataFrame, limit: float = 5.0, session: str = "session_id") -> DataFrame:
    """Sessions shorter than ``limit`` seconds with their first and last event."""
    at = F.struct(*ORDER)
    stats = K.aggregate_by(
        df, [session], events=F.count(F.lit(1)), start_time=F.min(TS), end_time=F.max(TS),
        first_event=F.min_by("event_type", at), last_event=F.max_by("event_type", at),
    )
    return stats.withColumn("seconds", C.seconds_between("start_time", "end_time")).where(F.col("seconds") < limit)


def short_session_report(df: DataFrame, limit: float = 5.0, session: str = "session_id") -> DataFrame:
    """Short sessions: how many, their share, rows and mean events."""
    spans = session_spans(df, session)
    short = F.col("seconds") < limit
    totals = spans.agg(
        F.count_if(short).alias("short_sessions"), F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum(F.when(short, F.col("events"))), F.lit(0)).alias("short_rows"), F.sum("events").alias("rows"),
    )
    return totals.withColumns({
        "session_percent": C.percent("short_sessions", "sessions"),
        "row_percent": C.percent("short_rows", "rows"),
        "mean_events": C.ratio("short_rows", "short_sessions"),
    })


def session_paths(df: DataFrame, ids: DataFrame, session: str = "session_id") -> DataFrame:
    """Ordered path of the given sessions, one row per step with the step that follows.

    The path stays in rows: one text per session would gather a session of any length in one task.
    """
    from dealflux.plans.ordered import following

    return following(K.keep_keys(df, ids), [session], ORDER, ["event_type"]).select(
        session, *ORDER, "event_type", "next_event_type"
    )


def two_event_paths(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions of exactly two events as (first, second)."""
    at = F.struct(*ORDER)
    pairs = K.aggregate_by(
        df, [session], n=F.count(F.lit(1)), first_event=F.min_by("event_type", at), second_event=F.max_by("event_type", at)
    )
    return pairs.where("n = 2").drop("n")


def non_standard_sessions(df: DataFrame, standard: Sequence[tuple[str, str]], session: str = "session_id") -> DataFrame:
    """Two-event sessions that follow none of the given pairs."""
    pairs = two_event_paths(df, session)
    for a, b in standard:
        pairs = pairs.where(~((F.col("first_event") == a) & (F.col("second_event") == b)))
    return pairs


def non_standard_profile(df: DataFrame, standard: Sequence[tuple[str, str]], top: int = 5, session: str = "session_id") -> DataFrame:
    """Rows of non-standard sessions: device and weekday shares, top cities, and a last row with
    the number of users (``n``) and the mean duration in seconds (``share``)."""
    ids = non_standard_sessions(df, standard, session).select(session)
    rows = with_duration(K.keep_keys(df, ids), session)
    rows = rows.withColumn("day_of_week", F.date_format(TS, "EEEE"))
    long = K.unpivot(rows, [], ["device_family", "city", "day_of_week"], "feature", "value")
    counts = K.present(long, "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    shares = K.share_of(counts, "n", ["feature"], "share")
    cities = K.top_per_group(shares.where("feature = 'city'"), ["feature"], top, F.desc("n"), F.asc("value"))
    ranked = shares.where("feature <> 'city'").unionByName(cities.drop("rank"))
    users = rows.agg(
        F.lit("all").alias("feature"), F.lit("users").alias("value"),
        F.count_distinct("user_id").alias("n"), F.avg("session_duration").alias("share"),
    )
    return ranked.unionByName(users)


def session_features(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Events, mode device and country, mean hour and duration of each session."""
    stats = K.aggregate_by(
        df, [session], events=F.count(F.lit(1)), mean_hour=F.avg(F.hour(TS)), start_time=F.min(TS), end_time=F.max(TS)
    ).withColumn("seconds", C.seconds_between("start_time", "end_time"))
    for c in ("device_family", "country"):
        stats = stats.join(K.mode_by(df, [session], c), session, "left")
    return stats.drop("start_time", "end_time")


def user_event_matrix(df: DataFrame, top: int = 20, user: str = "user_id") -> DataFrame:
    """Counts of the most frequent event types per user, long and sparse (absent = 0)."""
    kinds = K.top_keys(df, "event_type", F.count(F.lit(1)), top)
    return K.aggregate_by(K.keep_keys(df, kinds), [user, "event_type"], n=F.count(F.lit(1)))


def user_event_columns(df: DataFrame, top: int = 20, user: str = "user_id") -> DataFrame:
    """The same matrix with one column per event type and a row for every user."""
    kinds = [r.event_type for r in K.top_keys(df, "event_type", F.count(F.lit(1)), top).collect()]
    return K.present(df, user).groupBy(user).agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds]
    )


def language_metrics(df: DataFrame, session: str = "session_id", user: str = "user_id") -> DataFrame:
    """Row share, sessions per user, mean duration (minutes) and return rate by language."""
    rows = with_duration(df, session)
    base = K.aggregate_by(rows, ["language"], events=F.count(F.lit(1)), mean_minutes=F.avg("session_duration") / 60.0)
    per_user = K.aggregate_by(df, ["language", user], s=F.count_distinct(session))
    users = per_user.groupBy("language").agg(
        F.avg("s").alias("sessions_per_user"),
        (F.avg(F.when(F.col("s") > 1, 1.0).otherwise(0.0)) * 100).alias("return_rate"),
    )
    return K.share_of(base.join(users, "language", "left"), "events", (), "share")


def duration_ttest(df: DataFrame, group: str = "language", reference: str = "English", session: str = "session_id") -> DataFrame:
    """Pooled two-sample t statistic of row-level durations, reference against each group."""
    rows = with_duration(df, session)
    m = K.aggregate_by(
        rows, [group], n=F.count("session_duration"), mean=F.avg("session_duration"), var=F.var_samp("session_duration")
    )
    one = lambda c: K.scalar(m.where(F.col(group) == reference), F.max(c))
    others = m.where(F.col(group) != reference).select(
        group, "n", "mean", "var", one("n").alias("rn"), one("mean").alias("rmean"), one("var").alias("rvar")
    )
    df_ = F.col("n") + F.col("rn") - 2
    pooled = ((F.col("n") - 1) * F.col("var") + (F.col("rn") - 1) * F.col("rvar")) / df_
    error = F.sqrt(pooled * (1.0 / F.col("n") + 1.0 / F.col("rn")))
    return others.select(
        F.lit(reference).alias("reference"), group, df_.cast("bigint").alias("df"),
        C.ratio(F.col("rmean") - F.col("mean"), error).alias("t"),
    )


def ttest_p_values(stats: DataFrame) -> DataFrame:
    """Two-sided p-value by the normal limit of t, good for the large samples used here."""
    z = F.abs("t") / F.sqrt(F.lit(2.0))
    # Coefficients of the published erfc approximation 7.1.26 (Abramowitz, Stegun).
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = sum((F.lit(k) * F.pow(t, F.lit(i + 1.0)) for i, k in enumerate(a)), F.lit(0.0))
    return stats.withColumn("p_value", poly * F.exp(-z * z))


def session_correlation(df: DataFrame, *, trim: bool = False, factor: float = 1.5, session: str = "session_id") -> DataFrame:
    """Correlation of events and duration over sessions, optionally inside the IQR fences."""
    spans = session_spans(df, session)
    if trim:
        for c in ("events", "seconds"):
            q = K.exact_percentiles(spans, [], c, {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
            spans = spans.withColumn("_q", q)
            iqr = F.col("_q.q3") - F.col("_q.q1")
            spans = spans.where(
                (F.col(c) >= F.col("_q.q1") - factor * iqr) & (F.col(c) <= F.col("_q.q3") + factor * iqr)
            ).drop("_q")
    return spans.agg(F.count(F.lit(1)).alias("sessions"), F.corr("events", "seconds").alias("correlation"))


def feature_duration(df: DataFrame, features: Sequence[str], more_than: int = 1000, session: str = "session_id") -> DataFrame:
    """Mean duration and rows by each value of several features, for values with enough rows."""
    rows = with_duration(df, session)
    text = rows.select("session_duration", *[F.col(f).cast("string").alias(f) for f in features])
    long = K.unpivot(text, ["session_duration"], features, "feature", "value")
    means = K.aggregate_by(long, ["feature", "value"], mean_seconds=F.avg("session_duration"), n=F.count("session_duration"))
    return means.where(F.col("n") > more_than)

"""Gaussian hidden Markov model over event codes of sessions.

Sessions are stored as time segments of bounded length. A segment's effect on a state vector is a
K x K matrix, so a session of any length is handled in three parallel steps: matrices per segment,
a scan over each session's matrices, and sums (or paths) per segment given its ends. The scan goes up
and down a tree: runs of ``WIDTH`` matrices are multiplied, their products again, until a session has
one run; then every run learns its ends from the run above. So one long session is many tasks. Spark
moves the segments and adds up the sums; the driver only holds K x K parameters.

A fit first puts the segments of short sessions together and counts equal ones: its rounds read every
different sequence once, with its weight, and only sessions of more than ``WHOLE`` events are scanned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.plans.ordered import chunk_of
from dealflux.session import cut

FLOOR = 1e-3
#: Matrices of a session that one task multiplies or scans.
WIDTH = 64
#: Sessions of up to this many events are one sequence each in a fit.
WHOLE = 4096


@dataclass
class Hidden:
    """Start, transition, mean and variance of each state, ordered by mean."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    loglik: list[float]


def segments(df: DataFrame, code: str, session: str = "session_id", seconds: float = 3600.0, longest: int = 65_536) -> DataFrame:
    """One row per (session, time chunk, part) with its ordered event ids and codes.

    Chunks holding more than ``longest`` events are cut by position, so that an array stays
    small however many events a session has. ``chunk`` numbers the segments in order.
    """
    inside = Window.partitionBy(session, "_chunk").orderBy("event_time", "event_id")
    item = F.struct("event_time", "event_id", F.col(code).cast("double").alias("code"))
    part = F.floor((F.row_number().over(inside) - 1) / longest)
    rows = (
        df.where(F.col(session).isNotNull())
        .withColumn("_chunk", chunk_of("event_time", seconds))
        .withColumn("chunk", (F.col("_chunk") * (1 << 24) + part).cast("bigint"))
        .groupBy(F.col(session).alias("session_id"), "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("_i"))
    )
    order = Window.partitionBy("session_id").orderBy("chunk")
    numbers = rows.select("session_id", "chunk").withColumns({"number": F.row_number().over(order).cast("long") - 1, "segments": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    return rows.join(numbers, ["session_id", "chunk"]).select(
        "session_id", "chunk", F.col("_i.event_id").alias("ids"), F.col("_i.code").alias("obs"), (F.col("number") == 0).alias("first"), "number", "segments",
    )


def padded(obs):
    """Rows of different lengths as slices of (indices, matrix, lengths), each of bounded size."""
    lengths = np.array([len(o) for o in obs])
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        rows = order[at : at + max(1, 200_000 // max(width, 1))]
        block = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            block[i, : lengths[r]] = obs[r]
        yield rows, block, lengths[rows]
        at += len(rows)


def densities(block, h: Hidden):
    z = (block[:, :, None] - h.mean) ** 2 / h.var
    return np.exp(-0.5 * z) / np.sqrt(2 * math.pi * h.var) + 1e-300


def norm(v):
    total = v.sum(-1, keepdims=True)
    return v / np.where(total > 0, total, 1), total[..., 0]


def segment_matrix(h: Hidden, best: bool):
    """Per segment: log matrix from the state before it (or the start) to its last state.

    ``best`` takes the best path, otherwise all paths are summed.
    """
    k = len(h.mean)
    la = np.log(h.trans + 1e-300)

    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), k * k))
            for rows, block, lengths in padded(pdf.obs.values):
                lb = np.log(densities(block, h))
                first = pdf["first"].values[rows]
                m = np.where(first[:, None, None], np.where(np.eye(k) > 0, 0.0, -1e30)[None], la[None]) + lb[:, 0][:, None, :]
                for t in range(1, block.shape[1]):
                    paths = m[:, :, :, None] + la[None, None]
                    top = paths.max(2)
                    step = top if best else top + np.log(np.exp(paths - top[:, :, None]).sum(2))
                    m = np.where((t < lengths)[:, None, None], step + lb[:, t][:, None, :], m)
                out[rows] = m.reshape(len(rows), -1)
            yield pd.DataFrame({"owner": pdf.session_id, "n": pdf.number, "m": list(out)})

    return run


def whole_sessions(batches):
    """Regroup sorted Arrow batches so that each yielded frame holds whole sessions."""
    held = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = pdf.session_id.iloc[-1]
        if held and (pdf.session_id == held[0].session_id.iloc[0]).all():
            held.append(pdf)
            continue
        both = pd.concat([*held, pdf], ignore_index=True)
        open_rows = both.session_id == last
        if not open_rows.all():
            yield both[~open_rows]
        held = [both[open_rows]]
    if held:
        yield pd.concat(held, ignore_index=True)


def stacked(pdf, k, blank):
    """Sessions of similar segment counts as (row positions, matrices padded with ``blank``)."""
    counts = pdf.groupby("session_id", sort=False).size().to_numpy()
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    flat = np.array(pdf.m.tolist()).reshape(-1, k, k)
    order, at = np.argsort(-counts, kind="stable"), 0
    while at < len(order):
        width = int(counts[order[at]])
        some = order[at : at + max(1, 200_000 // width)]
        place = starts[some][:, None] + np.arange(width)[None]
        inside = np.arange(width)[None] < counts[some][:, None]
        ms = np.where(inside[:, :, None, None], flat[np.where(inside, place, 0)], blank)
        yield place, inside, ms
        at += len(some)


def apart(k: int) -> np.ndarray:
    """Log matrix that changes nothing."""
    return np.where(np.eye(k) > 0, 0.0, -1e30)


def products(h: Hidden, best: bool):
    """Per run of a session: the log matrix from its beginning to its end."""
    k = len(h.mean)

    def run(batches):
        for pdf in whole_sessions(batches):
            heads, made = [], []
            for place, _, ms in stacked(pdf, k, apart(k)):
                out = ms[:, 0]
                for g in range(1, ms.shape[1]):
                    paths = out[:, :, :, None] + ms[:, g][:, None]
                    top = paths.max(2)
                    out = top if best else top + np.log(np.exp(paths - top[:, :, None]).sum(2))
                heads.append(place[:, 0])
                made.append(out.reshape(len(out), -1))
            rows = pdf.iloc[np.concatenate(heads)]
            yield pd.DataFrame({"owner": rows.owner, "n": rows.n // WIDTH, "m": list(np.concatenate(made))})

    return run


def given(pdf: pd.DataFrame, column: str, place: np.ndarray, default: np.ndarray) -> np.ndarray:
    """What each run got from the run above it, or the default at the top."""
    if column not in pdf:
        return np.repeat(default[None], len(place), 0)
    return np.stack(pdf[column].values[place[:, 0]])


def chain(h: Hidden):
    """Per run: normalised state vector entering each matrix and weight of what follows it."""
    k = len(h.mean)

    def run(batches):
        for pdf in whole_sessions(batches):
            enter, after = np.zeros((len(pdf), k)), np.ones((len(pdf), k))
            for place, inside, ms in stacked(pdf, k, apart(k)):
                ms = np.exp(ms - ms.max((2, 3), keepdims=True))
                v = given(pdf, "enter0", place, h.start)
                for g in range(ms.shape[1]):
                    live = inside[:, g]
                    enter[place[live, g]] = v[live]
                    v = norm(np.einsum("si,sij->sj", v, ms[:, g]))[0]
                w = given(pdf, "after0", place, np.ones(k))
                for g in range(ms.shape[1] - 1, -1, -1):
                    live = inside[:, g]
                    after[place[live, g]] = w[live]
                    w = norm(np.einsum("sij,sj->si", ms[:, g], w))[0]
            yield pdf[["owner", "n"]].assign(enter=list(enter), after=list(after))

    return run


def in_runs(ms: DataFrame) -> DataFrame:
    """Matrices brought together and ordered by run: ``WIDTH`` neighbours of one session."""
    keyed = ms.withColumn("session_id", F.concat_ws("#", F.floor(F.col("n") / WIDTH).cast("string"), "owner"))
    return keyed.repartition("session_id").sortWithinPartitions("session_id", "n")


def scan(ms: DataFrame, h: Hidden, longest: int, step, ends: dict[str, str], best: bool) -> DataFrame:
    """(owner, n, ends) of every matrix, by way of products over runs; ``longest`` is a session's most matrices."""
    levels = [ms]
    while longest > WIDTH:
        levels[-1] = cut(levels[-1])
        levels.append(in_runs(levels[-1]).mapInPandas(products(h, best), "owner string, n long, m array<double>"))
        longest = -(-longest // WIDTH)
    found = None
    for rows in reversed(levels):
        if found is not None:
            above = found.select(F.col("owner").alias("_o"), F.col("n").alias("_n"), *[F.col(c).alias(f"{c}0") for c in ends])
            rows = rows.join(above, (F.col("owner") == F.col("_o")) & (F.floor(F.col("n") / WIDTH) == F.col("_n"))).drop("_o", "_n")
        found = in_runs(rows).mapInPandas(step(h), ", ".join(["owner string, n long", *[f"{c} {kind}" for c, kind in ends.items()]]))
    return found


def longest_session(segs: DataFrame) -> int:
    return segs.agg(F.max("segments")).first()[0] or 0


def expectation(h: Hidden):
    """Summed sufficient statistics of each batch of segments, one row per batch; ``weight`` counts equal segments."""
    k = len(h.mean)

    def run(batches):
        for pdf in batches:
            s = {"start": np.zeros(k), "trans": np.zeros((k, k)), "w": np.zeros(k), "x": np.zeros(k), "xx": np.zeros(k), "ll": 0.0}
            for rows, block, lengths in padded(pdf.obs.values):
                b = densities(block, h)
                first, weight = pdf["first"].values[rows], pdf.weight.values[rows].astype(float)
                enter = np.stack([h.start if e is None else np.asarray(e) for e in pdf.enter.values[rows]])
                after = np.stack([np.ones(k) if e is None else np.asarray(e) for e in pdf.after.values[rows]])
                n = block.shape[1]
                alpha, beta = np.zeros((len(rows), n, k)), np.zeros((len(rows), n, k))
                prior = np.where(first[:, None], enter, enter @ h.trans)
                alpha[:, 0], c = norm(prior * b[:, 0])
                s["ll"] += (weight * np.log(c)).sum()
                for t in range(1, n):
                    live = t < lengths
                    step, c = norm((alpha[:, t - 1] @ h.trans) * b[:, t])
                    alpha[:, t] = np.where(live[:, None], step, alpha[:, t - 1])
                    s["ll"] += (weight[live] * np.log(c[live])).sum()
                beta[:, n - 1] = after
                for t in range(n - 2, -1, -1):
                    step, _ = norm((b[:, t + 1] * beta[:, t + 1]) @ h.trans.T)
                    beta[:, t] = np.where((t + 1 < lengths)[:, None], step, after)
                gamma = norm(alpha * beta)[0] * (weight[:, None] * (np.arange(n)[None] < lengths[:, None]))[:, :, None]
                s["start"] += gamma[first, 0].sum(0)
                s["w"] += gamma.sum((0, 1))
                s["x"] += (gamma * block[:, :, None]).sum((0, 1))
                s["xx"] += (gamma * block[:, :, None] ** 2).sum((0, 1))
                ahead = b * beta
                moves = [(enter[~first], ahead[~first, 0], weight[~first])] + [
                    (alpha[t < lengths, t - 1], ahead[t < lengths, t], weight[t < lengths]) for t in range(1, n)
                ]
                for left, right, times in moves:
                    xi = left[:, :, None] * h.trans[None] * right[:, None, :]
                    total = xi.sum((1, 2), keepdims=True)
                    s["trans"] += (xi * (times[:, None, None] / np.where(total > 0, total, 1))).sum(0)
            flat = np.concatenate([s["start"], s["trans"].ravel(), s["w"], s["x"], s["xx"], [s["ll"]]])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    return run


MATRICES = "owner string, n long, m array<double>"


def with_ends(segs: DataFrame, h: Hidden, longest: int) -> DataFrame:
    """Segments with their entering and following vectors; only split sessions need the scan."""
    whole = segs.where("segments = 1").selectExpr("*", "cast(null as array<double>) enter", "cast(null as array<double>) after")
    split = segs.where("segments > 1")
    ms = split.mapInPandas(segment_matrix(h, False), MATRICES)
    ends = scan(ms, h, longest, chain, {"enter": "array<double>", "after": "array<double>"}, False)
    ends = ends.withColumnsRenamed({"owner": "session_id", "n": "number"})
    return whole.unionByName(split.join(ends, ["session_id", "number"]))


def sequences(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different sequences of sessions of up to ``WHOLE`` events with their weights, and the segments of longer sessions.

    Both are stored. Equal sequences give equal sums, so a round over the first table costs as much as it has rows.
    """
    sized = segs.join(segs.groupBy("session_id").agg(F.sum(F.size("obs")).alias("_events")), "session_id")
    parts = F.sort_array(F.collect_list(F.struct("number", "obs")))
    short = sized.where(F.col("_events") <= WHOLE).groupBy("session_id").agg(F.flatten(parts.getField("obs")).alias("obs"))
    known = short.groupBy("obs").agg(F.count(F.lit(1)).alias("weight"))
    # Dealt evenly: the rows are few and small, but every round works on them.
    dealt = known.repartition(segs.sparkSession.sparkContext.defaultParallelism)
    none = F.lit(None).cast("array<double>")
    weighted = dealt.select("obs", F.lit(True).alias("first"), "weight", none.alias("enter"), none.alias("after"))
    return cut(weighted), cut(sized.where(F.col("_events") > WHOLE).drop("_events"))


def initial(segs: DataFrame, states: int) -> Hidden:
    """Means spread evenly over the code range, one common variance, sticky transitions."""
    r = segs.select(F.explode("obs").alias("x")).agg(F.min("x"), F.max("x"), F.var_pop("x")).first()
    low, high, var = float(r[0]), float(r[1]), float(r[2])
    mean = low + (np.arange(states) + 0.5) * (high - low) / states
    trans = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Hidden(np.full(states, 1 / states), trans, mean, np.full(states, max(var, FLOOR)), [])


def fit(segs: DataFrame, *, states: int = 5, max_iter: int = 100, tol: float = 1e-2) -> Hidden:
    """Expectation-maximisation until the log-likelihood gains less than ``tol``.

    ``segs`` should be persisted or checkpointed by the caller; rounds read the sequences made of it.
    """
    h = initial(segs, states)
    whole, long = sequences(segs)
    k, longest, size = states, longest_session(long), 4 * states + states**2 + 1
    for _ in range(max_iter):
        read = whole
        if longest:
            ended = with_ends(long, h, longest).withColumn("weight", F.lit(1).cast("long"))
            read = whole.unionByName(ended.select(*whole.columns))
        sums = read.mapInPandas(expectation(h), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        flat = np.zeros(size)
        for r in sums.collect():
            flat[r.i] = r.v
        start, trans, rest = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :]
        w, x, xx, ll = rest[:k], rest[k : 2 * k], rest[2 * k : 3 * k], float(rest[3 * k])
        history = [*h.loglik, ll]
        w = np.maximum(w, 1e-12)
        mean = x / w
        rows = trans.sum(1, keepdims=True)
        h = Hidden(
            start / start.sum(), np.where(rows > 0, trans / np.where(rows > 0, rows, 1), 1 / k),
            mean, np.maximum(xx / w - mean**2, FLOOR), history,
        )
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
    order = np.argsort(h.mean)
    return Hidden(h.start[order], h.trans[np.ix_(order, order)], h.mean[order], h.var[order], h.loglik)


def parameters(h: Hidden, spark) -> DataFrame:
    """Transition matrix, means and variances as rows (K x K)."""
    rows = [
        (i, j, float(h.trans[i, j]), float(h.mean[i]), float(h.var[i]), float(h.start[i]))
        for i in range(len(h.mean)) for j in range(len(h.mean))
    ]
    return spark.createDataFrame(rows, "state int, to_state int, prob double, mean double, variance double, start double")


def best_ends(h: Hidden):
    """Per run: state before each matrix and state at its end, on the best path."""
    k = len(h.mean)

    def run(batches):
        for pdf in whole_sessions(batches):
            before, last = np.zeros(len(pdf), dtype=int), np.zeros(len(pdf), dtype=int)
            for place, inside, ms in stacked(pdf, k, apart(k)):
                at = np.arange(len(place))
                scores = [np.repeat(np.log(h.start + 1e-300)[None], len(place), 0)]
                if "before0" in pdf:
                    scores = [apart(k)[pdf.before0.values[place[:, 0]]]]
                for g in range(ms.shape[1]):
                    v = (scores[-1][:, :, None] + ms[:, g]).max(1)
                    scores.append(v - v.max(1, keepdims=True))
                end = pdf.last0.values[place[:, 0]] if "last0" in pdf else scores[-1].argmax(1)
                for g in range(ms.shape[1] - 1, -1, -1):
                    live = inside[:, g]
                    came = (scores[g] + ms[at, g, :, end]).argmax(1)
                    last[place[live, g]] = end[live]
                    before[place[live, g]] = came[live]
                    end = came
            yield pdf[["owner", "n"]].assign(before=before, last=last)

    return run


def paths(h: Hidden):
    """State of each event of a segment, given the state before it and its last state."""
    la = np.log(h.trans + 1e-300)

    def run(batches):
        for pdf in batches:
            states = [None] * len(pdf)
            for rows, block, lengths in padded(pdf.obs.values):
                lb = np.log(densities(block, h))
                first, before, last = (pdf[c].values[rows] for c in ("first", "before", "last"))
                at = np.arange(len(rows))
                # A first segment starts in the state ``before`` itself, without a transition.
                enter = np.where(first[:, None], np.where(np.arange(len(h.mean)) == before[:, None], 0.0, -1e30), la[before])
                score, back = enter + lb[:, 0], []
                for t in range(1, block.shape[1]):
                    cand = score[:, :, None] + la[None]
                    live = (t < lengths)[:, None]
                    back.append(np.where(live, cand.argmax(1), np.arange(len(h.mean))[None]))
                    score = np.where(live, cand.max(1) + lb[:, t], score)
                path = [last]
                for pointer in back[::-1]:
                    path.append(pointer[at, path[-1]])
                table = np.stack(path[::-1], axis=1)
                for i, r in enumerate(rows):
                    states[r] = table[i, : lengths[i]]
            yield pdf[["session_id", "ids"]].assign(states=states)

    return run


def best_path_ends(segs: DataFrame, h: Hidden) -> DataFrame:
    """(session_id, number, before, last): states before and at the end of every segment on its session's best path."""
    ms = segs.mapInPandas(segment_matrix(h, True), MATRICES)
    ends = scan(ms, h, longest_session(segs), best_ends, {"before": "long", "last": "long"}, True)
    return ends.withColumnsRenamed({"owner": "session_id", "n": "number"})


def decode(segs: DataFrame, h: Hidden) -> DataFrame:
    """Most likely state of every event."""
    placed = segs.join(best_path_ends(segs, h), ["session_id", "number"])
    found = placed.mapInPandas(paths(h), "session_id string, ids array<long>, states array<int>")
    return found.select("session_id", F.explode(F.arrays_zip("ids", "states")).alias("_z")).select(
        "session_id", F.col("_z.ids").alias("event_id"), F.col("_z.states").alias("state")
    )


def next_of_sessions(segs: DataFrame, h: Hidden, codes: int, top: int = 5) -> DataFrame:
    """Per session: its last state on the best path, and the codes most likely to follow it."""
    sizes = segs.select("session_id", "number", (F.col("number") == F.col("segments") - 1).alias("_end")).where("_end")
    last = best_path_ends(segs, h).join(sizes.drop("_end"), ["session_id", "number"]).select("session_id", F.col("last").cast("int").alias("state"))
    return last.join(F.broadcast(next_codes(h, codes, segs.sparkSession, top)), "state")


def code_mass(h: Hidden, codes: int) -> np.ndarray:
    """Gaussian mass of each integer code in each state, the tails going to the end codes."""
    cdf = lambda x, m, v: 0.5 * (1 + math.erf((x - m) / math.sqrt(2 * v)))
    edges = [-math.inf] + [c + 0.5 for c in range(codes - 1)] + [math.inf]
    return np.array([[cdf(b, m, v) - cdf(a, m, v) for a, b in zip(edges, edges[1:])] for m, v in zip(h.mean, h.var)])


def next_codes(h: Hidden, codes: int, spark, top: int = 5) -> DataFrame:
    """Per state: the codes most likely to follow, probabilities scaled to the shown ones."""
    probs = h.trans @ code_mass(h, codes)
    rows = []
    for state, p in enumerate(probs):
        best = np.argsort(-p, kind="stable")[:top]
        rows += [(state, r + 1, int(c), float(p[c] / p[best].sum())) for r, c in enumerate(best)]
    return spark.createDataFrame(rows, "state int, rank int, code int, prob double")

"""Multiclass gradient boosting on histograms, as Spark jobs.

Rows with equal bins and class are one weighted row. Each round fits one tree a class to the gradients
of the softmax loss, level by level: tasks add up gradients per class, node and bin of their rows,
Spark sums those histograms, and the driver picks splits from sums whose number depends on the model
(classes x nodes x bins) and not on the rows. Sums are whole numbers, so a fit is the same whatever
order rows come in. Margins of past rounds are stored every few rounds and completed on the fly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dealflux.session import cut

#: Bins of a numeric feature. Categories have one each.
NUMERIC_BINS = 64
#: Gradients are summed as multiples of this.
UNIT = 2.0**-20
#: Rounds between stored margins, and weighted rows of a task.
STORE_EVERY = 10
TASK_ROWS = 200_000
#: Combinations of bins whose scores a task remembers.
SEEN = 100_000
#: Loss is judged by probabilities no smaller than this.
LEAST = 1e-15


@dataclass
class Boosted:
    """Classes, bins per feature (category codes or upper edges) and one tree a class and round.

    A tree is a complete binary tree in breadth-first arrays: ``feature`` (-1 in a leaf), ``bin`` (rows up
    to it go left) and ``value``.
    """

    features: list[str]
    classes: list[str]
    bins: list[dict[str, int] | list[float]]
    base: np.ndarray
    depth: int
    rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)

    def widths(self) -> list[int]:
        """Bins of each feature; the last holds nulls and unknown categories."""
        return [len(b) + (1 if isinstance(b, dict) else 2) for b in self.bins]

    def coded(self, columns: Sequence[pd.Series]) -> np.ndarray:
        out = np.empty((len(columns[0]), len(columns)), np.int32)
        for j, (values, bins) in enumerate(zip(columns, self.bins, strict=True)):
            if isinstance(bins, dict):
                out[:, j] = values.map(bins).fillna(len(bins))
            else:
                x = values.to_numpy(dtype=float, na_value=np.nan)
                out[:, j] = np.where(np.isnan(x), len(bins) + 1, np.searchsorted(bins, x, side="left"))
        return out

    def margins(self, coded: np.ndarray, rounds: Sequence | None = None, start: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(coded), 1)) if start is None else start.copy()
        for trees in self.rounds if rounds is None else rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree[2][walk(tree, coded, self.depth)]
        return out


def walk(tree: tuple, coded: np.ndarray, depth: int) -> np.ndarray:
    """Node that each row has reached after at most ``depth`` steps."""
    feature, bound, _ = tree
    at = np.zeros(len(coded), np.int64)
    rows = np.arange(len(coded))
    for _ in range(depth):
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            break
        right = coded[rows, np.maximum(f, 0)] > bound[at]
        at = np.where(inner, 2 * at + 1 + right, at)
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histogram(model: Boosted, trees: list, coded: np.ndarray, label: np.ndarray, weight: np.ndarray, margins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradient and curvature sums, flat over (class, node of ``level``, bin of all features)."""
    p = softmax(margins)
    hit = np.zeros_like(p)
    hit[np.arange(len(label)), label] = 1.0
    g = np.rint(weight[:, None] * (p - hit) / UNIT)
    h = np.rint(weight[:, None] * np.maximum(2 * p * (1 - p), 1e-6) / UNIT)
    widths, first, nodes = model.widths(), 2**level - 1, 2**level
    total = sum(widths)
    out_g, out_h = np.zeros((2, len(model.classes) * nodes * total))
    for k, tree in enumerate(trees):
        at = walk(tree, coded, level) - first
        live = at >= 0
        offset = 0
        for j, width in enumerate(widths):
            slot = (k * nodes + at[live]) * total + offset + coded[live, j]
            out_g += np.bincount(slot, g[live, k], len(out_g))
            out_h += np.bincount(slot, h[live, k], len(out_h))
            offset += width
    return out_g, out_h


def split(model: Boosted, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, l2: float, least: float) -> tuple | None:
    """(gain, feature, bin, left value, right value) of the best split of one node's sums, or none that gains."""
    best, offset = None, 0
    for j, width in enumerate(model.widths()):
        if allowed[j] and width > 1:
            gs, hs = g[offset : offset + width], h[offset : offset + width]
            left_g, left_h = np.cumsum(gs)[:-1] * UNIT, np.cumsum(hs)[:-1] * UNIT
            right_g, right_h = gs.sum() * UNIT - left_g, hs.sum() * UNIT - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (gs.sum() * UNIT) ** 2 / (hs.sum() * UNIT + l2)
            gain[(left_h < least) | (right_h < least)] = -np.inf
            b = int(gain.argmax())
            if gain[b] > 1e-9 and (best is None or gain[b] > best[0]):
                best = (float(gain[b]), j, b, -left_g[b] / (left_h[b] + l2), -right_g[b] / (right_h[b] + l2))
        offset += width
    return best


def _bins(df: DataFrame, features: Sequence[str]) -> list[dict[str, int] | list[float]]:
    """Codes of text features in alphabetical order, edges of numeric ones at quantiles; few distinct values keep a bin each."""
    kinds, out = dict(df.dtypes), []
    for f in features:
        if kinds[f] == "string":
            names = sorted(r[0] for r in df.select(f).where(F.col(f).isNotNull()).distinct().collect())
            out.append({n: i for i, n in enumerate(names)})
        else:
            at = [(i + 1) / NUMERIC_BINS for i in range(NUMERIC_BINS)]
            edges = df.select(F.percentile_approx(F.col(f).cast("double"), at, 10_000)).first()[0]
            out.append(sorted(set(edges or []))[:-1])
    return out


_STATE = "bins array<int>, label int, weight double, margins array<double>"


def _arrays(batch: pa.RecordBatch, n_features: int, n_classes: int) -> tuple:
    bins = batch.column(0).flatten().to_numpy().reshape(-1, n_features)
    return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(-1, n_classes)


def _kept(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Weights thinned to ``share``: whole numbers whose mean is right, chosen by a hash of the row and the round."""
    if share >= 1:
        return weight
    mixed = np.full(len(label), seed * 2 + 1, np.uint64)
    for column in (*bins.T, label):
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.floor(share * weight + (mixed >> np.uint64(11)) / 2.0**53)


def fit(
    df: DataFrame, features: Sequence[str], label: str, *, rounds: int = 50, depth: int = 6, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8,
    l2: float = 1.0, least: float = 1.0, seed: int = 42,
) -> Boosted:
    """Boosted trees for a text label. Rows without a label are left out; nulls in features have a bin of their own.

    Each round looks at the share ``rows`` of the rows and ``columns`` of the features.
    """
    known = df.select(label, *features).where(F.col(label).isNotNull())
    counts = sorted(map(tuple, known.groupBy(label).count().collect()))
    classes, total = [c for c, _ in counts], sum(n for _, n in counts)
    if not classes:
        raise ValueError(f"no row has a {label}")
    model = Boosted(list(features), classes, _bins(known, features), np.log([n / total for _, n in counts]), depth)
    codes = {c: i for i, c in enumerate(classes)}

    @pandas_udf("array<int>")
    def coded(*values: pd.Series) -> pd.Series:
        return pd.Series(list(model.coded(values)))

    @pandas_udf("int")
    def code(names: pd.Series) -> pd.Series:
        return names.map(codes).astype("int32")

    # Equal rows are summed up before they are coded: Python sees each combination of values once.
    equal = known.groupBy(label, *features).agg(F.count(F.lit(1)).alias("_n"))
    cells = equal.select(coded(*features).alias("bins"), code(label).alias("label"), "_n").groupBy("bins", "label").agg(F.sum("_n").cast("double").alias("weight"))
    state = cut(cells.withColumn("margins", F.array(*[F.lit(float(b)) for b in model.base])))
    state = state.coalesce(max(1, min(state.rdd.getNumPartitions(), -(-state.count() // TASK_ROWS))))
    shape = (len(features), len(classes))
    size, draw = sum(model.widths()), np.random.default_rng(seed)
    pending: list = []
    for number in range(rounds):
        allowed = np.zeros(len(features), bool)
        allowed[draw.choice(len(features), max(1, round(columns * len(features))), replace=False)] = True
        trees = [(np.full(2 ** (depth + 1) - 1, -1, np.int32), np.zeros(2 ** (depth + 1) - 1, np.int32), np.zeros(2 ** (depth + 1) - 1)) for _ in classes]
        for level in range(depth):
            sums = _sums(state, model, list(pending), trees, level, shape, rows, seed + number)
            grown = False
            for k, tree in enumerate(trees):
                for node in range(2**level):
                    at, start = 2**level - 1 + node, (k * 2**level + node) * size
                    found = split(model, sums[0][start : start + size], sums[1][start : start + size], allowed, l2, least)
                    if found:
                        tree[0][at], tree[1][at] = found[1], found[2]
                        tree[2][2 * at + 1], tree[2][2 * at + 2] = rate * found[3], rate * found[4]
                        grown = True
            if not grown:
                break
        model.rounds.append(trees)
        pending.append(trees)
        if len(pending) == STORE_EVERY and number + 1 < rounds:
            state, pending = cut(_moved(state, model, pending, shape)), []
    return model


def _sums(state: DataFrame, model: Boosted, pending: list, trees: list, level: int, shape: tuple, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    def tally(batches):
        total = None
        for batch in batches:
            bins, label, weight, margins = _arrays(batch, *shape)
            part = histogram(model, trees, bins, label, _kept(bins, label, weight, share, seed), model.margins(bins, pending, margins), level)
            total = part if total is None else (total[0] + part[0], total[1] + part[1])
        if total is not None:
            slots = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[0][slots].astype(np.int64)), pa.array(total[1][slots].astype(np.int64))], names=["slot", "g", "h"])

    # One row per class, node and bin in use: the model's size, whatever the rows.
    found = state.mapInArrow(tally, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, len(model.classes) * 2**level * sum(model.widths())))
    out[:, found["slot"].to_numpy()] = found["g"].to_numpy(), found["h"].to_numpy()
    return out[0], out[1]


def _moved(state: DataFrame, model: Boosted, pending: list, shape: tuple) -> DataFrame:
    def move(batches):
        for batch in batches:
            bins, _, _, margins = _arrays(batch, *shape)
            moved = model.margins(bins, pending, margins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, moved.size + 1, shape[1]), pa.int32()), pa.array(moved.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=batch.schema.names)

    return state.mapInArrow(move, _STATE)


def chances_of(model: Boosted, batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Probabilities of every row; the trees are walked once for each combination of bins that a task meets."""
    seen: dict[bytes, np.ndarray] = {}
    for values in batches:
        cells, place = np.unique(model.coded(values), axis=0, return_inverse=True)
        keys = [c.tobytes() for c in cells]
        if len(seen) > SEEN:
            seen.clear()
        new = [i for i, k in enumerate(keys) if k not in seen]
        if new:
            seen.update(zip([keys[i] for i in new], softmax(model.margins(cells[new])), strict=True))
        yield pd.Series([seen[keys[i]] for i in place.ravel()])


def probabilities(model: Boosted, df: DataFrame, out: str = "probability") -> DataFrame:
    """``df`` with the probability of every class, in the order of ``model.classes``."""

    @pandas_udf("array<double>")
    def chances(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from chances_of(model, batches)

    return df.withColumn(out, chances(*model.features))


def likeliest(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``scored`` with the likeliest class of ``probability`` as ``prediction``; the first of equals."""
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("prediction", F.get(names, (F.array_position("probability", F.array_max("probability")) - 1).cast("int")))


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with ``probability`` and the likeliest class as ``prediction``; the first of equals."""
    return likeliest(probabilities(model, df), model.classes)


def top_classes(model: Boosted, df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """key, rank, event, prob: the ``top`` likeliest classes of each row, ranked inside the row."""
    names = F.array(*[F.lit(c) for c in model.classes])
    ranked = F.sort_array(F.transform("probability", lambda p, i: F.struct((-p).alias("m"), i.alias("i"))))
    wide = probabilities(model, df).select(key, F.posexplode(F.slice(ranked, 1, top)).alias("_r", "_c"))
    return wide.select(key, (F.col("_r") + 1).alias("rank"), F.get(names, F.col("_c.i")).alias("event"), (-F.col("_c.m")).alias("prob"))


def log_loss(scored: DataFrame, classes: Sequence[str], label: str, *by: str, weight: str | None = None) -> DataFrame:
    """Rows, accuracy and mean log-loss of ``probability``; a class that the model never saw has the least probability.

    A row of ``scored`` stands for as many rows as ``weight`` says, or for itself.
    """
    own = F.try_element_at("probability", F.nullif(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)), F.lit(0)).cast("int"))
    loss = -F.log(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(LEAST)))
    n = F.col(weight) if weight else F.lit(1)
    hit = F.col("prediction").eqNullSafe(F.col(label)).cast("double")
    return scored.groupBy(*by).agg(F.sum(n).alias("rows"), (F.sum(hit * n) / F.sum(n)).alias("accuracy"), (F.sum(loss * n) / F.sum(n)).alias("log_loss"))

"""Random forest for numbers over binned features, as Spark jobs.

Rows become bins of their features (a byte each), codes of their categories (two bytes each) and their label. Each category
is a feature of its own, 1 on its rows and 0 elsewhere; one sum by category and node serves all of a column's. The trees grow together, level by level:
tasks add up weights and labels of their rows for every tree, node and bin of the node's features, the sums
of a few nodes of a tree meet in one group, which finds their best splits, and only splits travel to the
driver. A row's place in a tree is walked anew from its bins, and how often a tree's bootstrap draws it
(Poisson, mean 1) follows from a hash of the row, so no level stores anything for each row and tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dealflux.operators.models import SEED, complete
from dealflux.session import cut

BINS = 32
#: Rows of a task: at most this many, and fewer while cores are free; a task's sums are as large as a level of the model.
TASK_ROWS, LEAST_ROWS = 1_000_000, 20_000
#: Rows walked at once, and nodes of a tree whose sums meet in one group.
CHUNK, GROUP_NODES = 1 << 16, 64
#: Bin that no row passes: below a leaf, all rows go left.
LEAF = 255
#: Times that a row is drawn, by 16 bits of its hash.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Forest:
    """Upper edges of each feature's bins; per tree the feature and bin of inner nodes and the mean label of all, breadth first.

    ``categories`` has columns with their values; the values count as features behind ``features``, column by column.
    """

    features: list[str]
    edges: list[list[float]]
    depth: int
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    categories: list[tuple[str, list[str]]] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.features) + sum(len(names) for _, names in self.categories)

    def codes(self, columns: Sequence) -> np.ndarray:
        """Number of each row's value in its column, behind the last one for null and unknown values."""
        out = []
        for c, (_, names) in zip(columns, self.categories, strict=True):
            found = pa.compute.index_in(c if isinstance(c, pa.Array) else pa.array(c, pa.string()), pa.array(names, pa.string()))
            out.append(pa.compute.fill_null(found, len(names)).to_numpy(zero_copy_only=False).astype(np.uint16))
        return np.stack(out, axis=1)

    def wide(self, coded: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
        """Bins of all features; a category's is 1 on its rows."""
        if codes is None:
            return coded
        return np.concatenate([coded, *[codes[:, j, None] == np.arange(len(names)) for j, (_, names) in enumerate(self.categories)]], axis=1, dtype=np.uint8, casting="unsafe")

    def coded(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, np.asarray(c, float), side="left").astype(np.uint8) for c, e in zip(columns, self.edges, strict=True)], axis=1)

    def walk(self, tree: int, flat: np.ndarray, start: np.ndarray, levels: int) -> np.ndarray:
        """Breadth-first number of the node that each row has reached; ``start`` is a row's first bin in ``flat``."""
        at = np.zeros(len(start), np.int64)
        feature, bound = self.feature[tree], self.bound[tree]
        # Every place is inside: clipping spares a check of each.
        for _ in range(levels):
            place = feature.take(at, mode="clip")
            place += start
            right = flat.take(place, mode="clip") > bound.take(at, mode="clip")
            at *= 2
            at += 1
            at += right
        return at

    def predict(self, coded: np.ndarray) -> np.ndarray:
        flat, start, out = coded.ravel(), np.arange(len(coded)) * coded.shape[1], np.zeros(len(coded))
        for tree in range(len(self.feature)):
            out += self.value[tree][self.walk(tree, flat, start, self.depth)]
        return out / len(self.feature)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def draws(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (hash ``h``) is drawn for ``tree``; a hash serves four trees."""
    own = mixed(h ^ mixed(np.array([seed * 65_537 + tree // 4 + 1], np.uint64)))
    return DRAWN[(own >> np.uint64(16 * (tree % 4))).astype(np.uint16)]


def edges_of(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Upper edges of each feature's bins at quantiles; up to ``BINS`` distinct values have a bin each."""
    at = [(i + 1) / BINS for i in range(BINS)]
    values = [F.col(f).cast("double") for f in features]
    row = df.select(*[F.percentile_approx(v, at, 10_000) for v in values], *[F.approx_count_distinct(v) for v in values]).first()
    out = []
    for f, edges, distinct in zip(features, row[: len(features)], row[len(features) :], strict=True):
        if distinct <= 2 * BINS:
            own = sorted(r[0] for r in df.select(F.col(f).cast("double")).distinct().limit(8 * BINS).collect())
            edges = own if len(own) <= BINS else edges
        out.append(sorted(set(edges or []))[:-1])
    return out


class Layout:
    """Where a level's sums stand in a tree's array: node by node the bins of its asked features, then each column's categories and its rows of none."""

    def __init__(self, model: Forest, asked: np.ndarray):
        sizes = [len(names) + 1 for _, names in model.categories]
        self.binned, self.column = len(model.features), np.cumsum([0, *sizes])[:-1]
        #: Number of asked features with bins, and a node's first place, by tree and node.
        self.n = (asked < self.binned).sum(axis=2)
        self.start = np.pad((self.n * BINS + sum(sizes)).cumsum(axis=1), ((0, 0), (1, 0)))
        #: Place of each category among a node's sums by category; the first column's sums are the node's.
        self.place = np.concatenate([np.arange(0), *[e + np.arange(n - 1) for e, n in zip(self.column, sizes)]])
        self.first = sizes[0] if sizes else 0

    def unfolded(self, held: np.ndarray, n: int, asked: np.ndarray) -> np.ndarray:
        """(asked feature x bin) of one node from its part of the sums; a category has the bins 0 and 1."""
        out = np.zeros((len(asked), BINS))
        out[:n] = held[: n * BINS].reshape(n, BINS)
        if n < len(asked):
            by_category = held[n * BINS :]
            out[n:, 1] = by_category[self.place[asked[n:] - self.binned]]
            out[n:, 0] = by_category[: self.first].sum() - out[n:, 1]
        return out


def _tally(model: Forest, layout: Layout, asked: np.ndarray, level: int, coded: np.ndarray, codes: np.ndarray | None, y: np.ndarray, h: np.ndarray, seed: int, sums: list[np.ndarray]) -> None:
    """Adds the rows' weights and labels to ``sums`` (by tree: 2 x ``layout``)."""
    wide = model.wide(coded, codes)
    flat, width = wide.ravel(), wide.shape[1]
    by_category = [codes[:, j].astype(np.int64) + column for j, column in enumerate(layout.column)]
    first = 2**level - 1
    for tree, out in enumerate(sums):
        times = draws(h, tree, seed)
        kept = np.flatnonzero(times != 0)
        w = times[kept].astype(float)
        wy, start = w * y[kept], kept * width
        node = model.walk(tree, flat, start, level) - first
        n, at = layout.n[tree], layout.start[tree].take(node)
        if by_category:
            behind = at + n.take(node) * BINS
        for place in by_category:
            slot = behind + place[kept]
            out[0] += np.bincount(slot, w, out.shape[1])
            out[1] += np.bincount(slot, wy, out.shape[1])
        for s in range(n.max(initial=0)):
            if n.min() <= s:
                some = np.flatnonzero((n > s)[node])
                node, at, start, w, wy = node[some], at[some], start[some], w[some], wy[some]
            slot = start + asked[tree, :, s].take(node)
            slot = flat.take(slot) + at
            slot += s * BINS
            out[0] += np.bincount(slot, w, out.shape[1])
            out[1] += np.bincount(slot, wy, out.shape[1])


def best_splits(w: np.ndarray, wy: np.ndarray, asked: np.ndarray) -> dict[str, np.ndarray]:
    """Best split of each node from its sums (node, asked feature, bin); the variance that it removes must be above 0.

    Of splits that differ in their sums' last digits only, as those by two categories that share a node, the first is the best.
    """
    total, whole = w[:, 0].sum(axis=1), wy[:, 0].sum(axis=1)
    left, left_y = w.cumsum(axis=2)[:, :, :-1], wy.cumsum(axis=2)[:, :, :-1]
    right, right_y = total[:, None, None] - left, whole[:, None, None] - left_y
    kept = left_y**2 / np.maximum(left, 1) + right_y**2 / np.maximum(right, 1)
    gain = kept - (whole**2 / np.maximum(total, 1))[:, None, None]
    gain[(left < 1) | (right < 1)] = -np.inf
    flat, kept = gain.reshape(len(gain), -1), kept.reshape(len(gain), -1)
    rows, at = np.arange(len(flat)), flat.argmax(axis=1)
    at = (flat >= (flat[rows, at] - 1e-10 * kept[rows, at])[:, None]).argmax(axis=1)
    place, bound = np.divmod(at, gain.shape[2])
    ok = flat[rows, at] > 1e-12 * np.maximum(whole**2 / np.maximum(total, 1), 1e-300)
    sides = [sy[rows, place, bound][ok] / s[rows, place, bound][ok] for s, sy in ((left, left_y), (right, right_y))]
    return {"node": rows[ok], "feature": asked[rows, place][ok], "bound": bound[ok], "left": sides[0], "right": sides[1]}


def fit(
    df: DataFrame, features: Sequence[str], label: str, key: str, *, categories: Sequence[str] = (), trees: int = 100, depth: int = 10, seed: int = SEED
) -> Forest:
    """Mean of ``trees`` trees, each on a bootstrap of the complete rows; a node looks at a third of the features.

    Every value of the columns ``categories`` is a feature (1 on its rows, else 0); null is none of them, nor is a value that was
    not learnt. Rows equal in key, features and label are drawn together. A fit does not depend on how rows are divided, but for
    the last digits of sums.
    """
    names = [F.col(c).cast("string").alias(c) for c in categories]
    known = df.where(complete(df, [*features, label])).select(key, *features, *names, F.col(label).cast("double").alias("_y"))
    total, mean = known.agg(F.count(F.lit(1)), F.avg("_y")).first()
    if not total:
        raise ValueError(f"no row has all features and a {label}")
    inner = 2**depth - 1
    model = Forest(list(features), edges_of(known, features), depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), LEAF, np.uint8), np.zeros((trees, 2 * inner + 1)))
    model.categories = [(c, sorted(r[0] for r in known.select(c).distinct().collect() if r[0] is not None)) for c in categories]
    if any(len(values) >= 1 << 16 for _, values in model.categories):
        raise ValueError("a column has more categories than two bytes can number")
    width, taken = model.width, -(-model.width // 3)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = model.coded([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            if categories:
                coded = np.concatenate([coded, model.codes([batch.column(c) for c in categories]).view(np.uint8)], axis=1)
            bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(coded.shape[1]), len(coded), [None, pa.py_buffer(coded.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([bins, batch.column("_y"), batch.column("_h")], names=["bins", "y", "h"])

    hashed = known.select(*features, *categories, (F.col("_y") - mean).alias("_y"), F.xxhash64(key, *features, *categories, "_y").alias("_h"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(2 * cores, -(-total // LEAST_ROWS)), -(-total // TASK_ROWS))
    state = cut(hashed.repartition(tasks, "_h").mapInArrow(code, "bins binary, y double, h long"))
    draw = np.random.default_rng(seed)
    alive = np.ones((trees, 1), bool)
    for level in range(depth):
        nodes = 2**level
        asked = np.argsort(draw.random((trees, nodes, width)), axis=2)[:, :, :taken].astype(np.int32)
        # Features with bins stand before categories.
        asked = np.take_along_axis(asked, np.argsort(asked >= len(features), axis=2, kind="stable"), axis=2)
        found = _level(state, model, asked, level, seed)
        tree, node = found["tree"].to_numpy(), found["node"].to_numpy()
        at = nodes - 1 + node
        ok = alive[tree, node]
        # Below a leaf all rows go left, and the child keeps its value.
        model.value[:, 2 * nodes - 1 : 4 * nodes - 1] = np.repeat(model.value[:, nodes - 1 : 2 * nodes - 1], 2, axis=1)
        for column, values in (("feature", model.feature), ("bound", model.bound)):
            values[tree[ok], at[ok]] = found[column].to_numpy()[ok]
        for side, child in (("left", 2 * at + 1), ("right", 2 * at + 2)):
            model.value[tree[ok], child[ok]] = found[side].to_numpy()[ok]
        alive = np.zeros((trees, 2 * nodes), bool)
        alive[tree[ok], 2 * node[ok]] = alive[tree[ok], 2 * node[ok] + 1] = True
        if not ok.any():
            model.depth = level
            break
    model.value += mean
    return model


def _level(state: DataFrame, model: Forest, asked: np.ndarray, level: int, seed: int) -> pa.Table:
    """(tree, node, feature, bound, left, right) of all nodes of a level that have a split."""
    trees, nodes, _ = asked.shape
    binned, layout = len(model.features), Layout(model, asked)
    # Rows whose features fit into CHUNK rows of 64 bytes.
    rows_at_once = max(1, min(CHUNK, CHUNK * 64 // model.width))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = [np.zeros((2, n)) for n in layout.start[:, -1]], []

        def add() -> None:
            stored = np.concatenate([np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8) for b in held])
            y, h = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("y", "h"))
            stored = stored.reshape(len(y), -1)
            coded, codes = stored[:, :binned], np.ascontiguousarray(stored[:, binned:]).view(np.uint16) if model.categories else None
            for i in range(0, len(y), rows_at_once):
                part = slice(i, i + rows_at_once)
                _tally(model, layout, asked, level, coded[part], None if codes is None else codes[part], y[part], h[part].view(np.uint64), seed, sums)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                add()
        if held:
            add()
        for tree in range(trees):
            ends = layout.start[tree]
            out = [(g, sums[tree][:, ends[g] : ends[min(g + GROUP_NODES, nodes)]]) for g in range(0, nodes, GROUP_NODES)]
            out = [(g, s) for g, s in out if s[0].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(out), pa.int32()), pa.array([g for g, _ in out], pa.int32()), pa.array([s.tobytes() for _, s in out], pa.binary())], names=["tree", "first", "sums"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, first = int(pdf.tree.iloc[0]), int(pdf["first"].iloc[0])
        own, n = asked[tree, first : first + GROUP_NODES], layout.n[tree]
        ends = layout.start[tree, first:] - layout.start[tree, first]
        both = sum(np.frombuffer(s) for s in sorted(pdf.sums)).reshape(2, -1)
        w, wy = (np.stack([layout.unfolded(side[ends[i] : ends[i + 1]], n[first + i], own[i]) for i in range(len(own))]) for side in both)
        rows = pd.DataFrame(best_splits(w, wy, own))
        return rows.assign(tree=tree, node=rows.node + first)[["tree", "node", "feature", "bound", "left", "right"]]

    sums = state.mapInArrow(tally, "tree int, first int, sums binary")
    return sums.groupBy("tree", "first").applyInPandas(find, "tree int, node long, feature long, bound long, left double, right double").toArrow()


def predict(model: Forest, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; null on rows that lack a feature."""

    @pandas_udf("double")
    def mean(*columns: pd.Series) -> pd.Series:
        coded, n = model.coded(columns[: len(model.features)]), len(model.features)
        return pd.Series(model.predict(model.wide(coded, model.codes(columns[n:]) if model.categories else None)))

    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features]
    values += [F.col(c).cast("string") for c, _ in model.categories]
    return df.withColumn("_made", mean(*values)).withColumn("prediction", F.when(complete(df, model.features), F.col("_made"))).drop("_made")

"""Random forests for classes over few features, grown from counts of binned cells.

Rows with equal bins take the same way through any tree, so a forest over at most ``MOST`` features needs only
the number of rows of each class in every cell. There are at most ``BINS`` + 1 to the power of the features such
cells, whatever the rows. Each tree is one group of a Spark job: it draws its bootstrap (a cell of n rows is
drawn Poisson(n) times, as n rows drawn Poisson(1) times each) and returns the chance of class 1 in every cell.
No tree comes to the driver; rows get their cell's mean chance by a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflux.operators.models import SEED, complete, successors
from dealflux.session import cut

BINS = 32
MOST = 3
#: Chances are summed as multiples of this, so that a sum does not depend on the trees' order.
UNIT = 2.0**-40


def edges_of(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Upper edges of each feature's bins at quantiles; few distinct values keep a bin each."""
    at = [(i + 1) / BINS for i in range(BINS)]
    row = df.select(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000) for f in features]).first()
    return [sorted(set(e or []))[:-1] for e in row]


def _below(value: Column):
    return lambda edge: F.when(edge < value, 1).otherwise(0)


def cell_of(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """Number of a row's cell: its bins as digits, the first feature's lowest."""
    number, times = F.lit(0).cast("long"), 1
    for f, e in zip(features, edges, strict=True):
        bounds = F.array(*[F.lit(float(x)) for x in e]) if e else F.array().cast("array<double>")
        value = F.col(f).cast("double")
        number, times = number + F.size(F.array_remove(F.transform(bounds, _below(value)), 0)) * times, times * (len(e) + 1)
    return number


def grow_classes(bins: np.ndarray, counts: np.ndarray, depth: int, draw: np.random.Generator, unordered: Sequence[bool] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each class (row of ``counts``) in each cell, and each feature's share of the impurity that the splits remove (Gini).

    The bins of an ``unordered`` feature are split in order of their impurity inside the node.
    """
    count, features = bins.shape
    classes = range(len(counts))
    taken = math.ceil(math.sqrt(features))
    w = np.stack([draw.poisson(n) for n in counts]).astype(float)
    chance, gained = np.zeros((len(counts), count)), np.zeros(features)
    live, node = np.arange(count), np.zeros(count, np.int64)
    for level in range(depth + 1):
        nodes = int(node.max()) + 1
        whole = np.stack([np.bincount(node, w[c, live], nodes) for c in classes])
        total = whole.sum(0)
        impure = total - (whole**2).sum(0) / np.maximum(total, 1)
        best, which, bound = np.full(nodes, 1e-9), np.full(nodes, -1), np.zeros(nodes, np.int64)
        places = {}
        allowed = np.argsort(draw.random((nodes, features)), axis=1) < taken
        for j in range(features if level < depth else 0):
            width = int(bins[:, j].max()) + 1
            slot = node * width + bins[live, j]
            sums = np.stack([np.bincount(slot, w[c, live], nodes * width).reshape(nodes, width) for c in classes])
            if width < 2:
                continue
            if len(unordered) and unordered[j]:
                n = sums.sum(0)
                order = np.argsort(1 - (sums**2).sum(0) / np.maximum(n, 1) ** 2, axis=1, kind="stable")
                places[j] = np.argsort(order, axis=1, kind="stable")
                sums = np.take_along_axis(sums, order[None], axis=2)
            left = sums.cumsum(2)[:, :, :-1]
            right = whole[:, :, None] - left
            sides = [(s.sum(0), (s**2).sum(0)) for s in (left, right)]
            gain = impure[:, None] - sum(n - sq / np.maximum(n, 1) for n, sq in sides)
            gain[(sides[0][0] < 1) | (sides[1][0] < 1) | ~allowed[:, j, None]] = -np.inf
            at = gain.argmax(1)
            value = gain[np.arange(nodes), at]
            better = value > best
            best[better], which[better], bound[better] = value[better], j, at[better]
        split = which >= 0
        np.add.at(gained, which[split], best[split])
        ends = ~split[node]
        chance[:, live[ends]] = (whole / np.maximum(total, 1))[:, node[ends]]
        live, node = live[~ends], node[~ends]
        if not len(live):
            break
        asked = which[node]
        place = bins[live, asked]
        for j, ranked in places.items():
            own = asked == j
            place[own] = ranked[node[own], place[own]]
        node = 2 * node + (place > bound[node])
        node = np.unique(node, return_inverse=True)[1]
    return chance, gained / max(gained.sum(), 1e-300)


def grow(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Chance of class 1 of each cell, and each feature's share of the impurity that the splits remove (Gini)."""
    chance, gained = grow_classes(bins, np.stack([n0, n1]), depth, draw)
    return chance[1], gained


def fit_and_score(
    train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, *, trees: int = 100, depth: int = 30, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``prediction`` and ``score`` (chance of class 1; both null on rows that lack a feature), and (feature, importance).

    The forest learns from ``train``'s complete rows.
    """
    if len(features) > MOST:
        raise ValueError(f"cells of {len(features)} features are too many; use random_forest_classifier")
    known = train.where(complete(train, [*features, label])).select(label, *features)
    edges = edges_of(known, features)
    widths = [len(e) + 1 for e in edges]
    placed = rows.withColumn("_cell", F.when(complete(rows, features), cell_of(features, edges)))
    learnt = known.select(cell_of(features, edges).alias("cell"), F.col(label).cast("int").alias("y"))
    asked = placed.where("_cell is not null").select(F.col("_cell").alias("cell"), F.lit(None).cast("int").alias("y"))
    counts = learnt.unionByName(asked).groupBy("cell").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    cells = cut(counts)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        bins = np.stack(np.unravel_index(pdf.cell.to_numpy(), widths, order="F"), axis=1)
        chance, gained = grow(bins, pdf.n0.to_numpy(), pdf.n1.to_numpy(), depth, np.random.default_rng([seed, int(pdf.tree.iloc[0])]))
        number = np.concatenate([pdf.cell.to_numpy(), -1 - np.arange(len(features))])
        return pd.DataFrame({"cell": number, "v": np.rint(np.concatenate([chance, gained]) / UNIT).astype(np.int64)})

    grown = cells.crossJoin(cells.sparkSession.range(trees).withColumnRenamed("id", "tree")).groupBy("tree").applyInPandas(tree, "cell long, v long")
    means = cut(grown.groupBy("cell").agg((F.sum("v") * F.lit(UNIT) / trees).alias("score")))
    scored = placed.join(means.where("cell >= 0"), placed["_cell"] == means["cell"], "left").drop("_cell", "cell")
    names = F.array(*[F.lit(f) for f in features])
    importance = means.where("cell < 0").select(F.get(names, (-1 - F.col("cell")).cast("int")).alias("feature"), F.col("score").alias("importance"))
    return scored.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).when(F.col("score").isNotNull(), 0.0)), importance


def class_chances(cells: DataFrame, features: Sequence[str], label: str, learns: Column, weight: str, *, trees: int = 50, depth: int = 6, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """``cells`` with ``probability`` of every class, and the classes in order.

    A row of ``cells`` stands for ``weight`` rows with its values; the forest learns from those that ``learns`` marks and that
    have a label. Every value of a feature has a bin of its own, null too; bins of text are unordered. A tree's task holds the
    distinct combinations of values, however many rows have them.
    """
    known = learns & F.col(label).isNotNull()
    classes = sorted(r[0] for r in cells.where(known).select(label).distinct().collect())
    if not classes:
        raise ValueError(f"no row has a {label}")
    fs, kinds, codes = list(features), dict(cells.dtypes), {c: i for i, c in enumerate(classes)}
    unordered = [kinds[f] == "string" for f in fs]
    counts = cut(cells.groupBy(*fs, label).agg(F.sum(F.when(known, F.col(weight)).otherwise(0)).alias("n")))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        coded = np.stack([pd.factorize(pdf[f], sort=True, use_na_sentinel=False)[0] for f in fs], axis=1)
        bins, first, cell = np.unique(coded, axis=0, return_index=True, return_inverse=True)
        n = np.zeros((len(classes), len(bins)), np.int64)
        learnt = pdf.n.to_numpy() > 0
        np.add.at(n, (pdf[label][learnt].map(codes).to_numpy(np.int64), cell.ravel()[learnt]), pdf.n.to_numpy()[learnt])
        chance, _ = grow_classes(bins, n, depth, np.random.default_rng([seed, int(pdf.tree.iloc[0])]), unordered)
        return pdf[fs].iloc[first].assign(v=list(np.rint(chance.T / UNIT).astype(np.int64)))

    schema = ", ".join(f"`{f}` {kinds[f]}" for f in fs)
    grown = counts.crossJoin(cells.sparkSession.range(trees).withColumnRenamed("id", "tree")).groupBy("tree").applyInPandas(tree, f"{schema}, v array<long>")
    sums = [F.sum(F.get("v", F.lit(i))) * F.lit(UNIT) / trees for i in range(len(classes))]
    means = cut(grown.groupBy(*[F.col(f).alias(f"_{f}") for f in fs]).agg(F.array(*sums).alias("probability")))
    same = [cells[f].eqNullSafe(means[f"_{f}"]) for f in fs]
    return cells.join(means, same, "left").select(*cells.columns, "probability"), classes


def importances(df: DataFrame, features: Sequence[str], label: str, key: str, **options) -> DataFrame:
    """feature, importance (impurity), rank and permutation_importance: the loss of accuracy when one feature's values move to the next row in hash order."""
    wide = successors(df, features, label, key)
    moved = wide.select(label, *features, F.lit("").alias("moved"))
    for f in features:
        other = [F.col(f"_other.{f}").alias(f) if g == f else F.col(g) for g in features]
        moved = moved.unionByName(wide.select(label, *other, F.lit(f).alias("moved")))
    scored, impurity = fit_and_score(df, moved, features, label, **options)
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    accuracy = cut(scored.groupBy("moved").agg(hit.alias("accuracy")))
    base = accuracy.where("moved = ''").select("accuracy").scalar()
    lost = accuracy.where("moved <> ''").select(F.col("moved").alias("feature"), (base - F.col("accuracy")).alias("permutation_importance"))
    place = {f: i for i, f in enumerate(features)}
    rows = sorted(impurity.collect(), key=lambda r: (-r.importance, place[r.feature]))
    ranked = df.sparkSession.createDataFrame([(r.feature, r.importance, i + 1) for i, r in enumerate(rows)], "feature string, importance double, rank int")
    return ranked.join(lost, "feature")

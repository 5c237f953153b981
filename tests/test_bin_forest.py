"""Binned regression forest: planted structure, splits against brute force, the same fit however rows are divided."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflux.operators import bin_forest as G
from dealflux.operators import models as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(3000):
        a, b, c = float(rng.uniform(0, 10)), int(rng.integers(0, 4)), float(rng.normal())
        y = 1000.0 + 100 * (a > 5) + 50 * (b == 3) + float(rng.normal())
        data.append((i, None if i == 7 else a, b, float("nan") if i == 8 else c, y))
    return spark.createDataFrame(data, "id long, a double, b int, c double, y double").persist()


def test_planted_structure_is_found_on_every_row(rows):
    model = G.fit(rows.where("id % 5 > 0"), FEATURES, "y", "id", trees=20, depth=6)
    got = {r.id: r for r in G.predict(model, rows).collect()}
    assert len(got) == 3000 and got[7].prediction is None and got[8].prediction is None
    held = [r for r in got.values() if r.id % 5 == 0 and r.prediction is not None]
    ours = np.mean([(r.y - r.prediction) ** 2 for r in held])
    theirs = M.score(M.random_forest_regressor(rows.where("id % 5 > 0"), FEATURES, "y", trees=20, depth=6), rows.where("id % 5 = 0"))
    assert ours < 1.5 * theirs.where("prediction is not null").agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]


def test_a_fit_does_not_follow_the_division_of_rows_and_stores_nothing_per_row(rows, monkeypatch):
    one = G.fit(rows.coalesce(1), FEATURES, "y", "id", trees=5, depth=4)
    monkeypatch.setattr(G, "TASK_ROWS", 300)
    monkeypatch.setattr(G, "CHUNK", 100)
    two = G.fit(rows.orderBy(F.desc("c")).repartition(7), FEATURES, "y", "id", trees=5, depth=4)
    assert (one.feature == two.feature).all() and (one.bound == two.bound).all()
    assert np.allclose(one.value, two.value, rtol=1e-12) and one.value.shape == (5, 31)


def test_splits_against_brute_force():
    rng = np.random.default_rng(1)
    codes, y, w = rng.integers(0, 6, (200, 2)), rng.normal(size=200), rng.integers(0, 4, 200).astype(float)
    sums = np.zeros((2, 1, 2, G.BINS))
    for j in (0, 1):
        np.add.at(sums[0, 0, j], codes[:, j], w)
        np.add.at(sums[1, 0, j], codes[:, j], w * y)
    found = G.best_splits(*sums, np.array([[0, 1]]))
    spread = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
    best = min((spread(codes[:, j] <= b) + spread(codes[:, j] > b), j, b) for j in (0, 1) for b in range(5))
    assert (found["feature"][0], found["bound"][0]) == best[1:]
    m = codes[:, best[1]] <= best[2]
    assert np.isclose(found["left"][0], np.average(y[m], weights=w[m])) and np.isclose(found["right"][0], np.average(y[~m], weights=w[~m]))


def test_draws_are_poisson_and_apart():
    h = np.arange(200_000, dtype=np.uint64)
    d = np.stack([G.draws(h, t, 42) for t in range(8)]).astype(float)
    assert np.allclose(d.mean(axis=1), 1, atol=0.02) and np.allclose(d.var(axis=1), 1, atol=0.03)
    assert np.abs(np.corrcoef(d) - np.eye(8)).max() < 0.01


def test_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(20)], "id long, a double, y double")
    got = G.predict(G.fit(df, ["a"], "y", "id", trees=3, depth=3), df).collect()
    assert len(got) == 20 and all(abs(r.prediction - 3.0) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        G.fit(df.where("a < 0"), ["a"], "y", "id")


def test_each_category_is_a_feature(spark):
    rng = np.random.default_rng(3)
    names = ["ash", "birch", "cedar", "elm", None]
    data = [(i, float(rng.uniform(0, 1)), names[i % 5], f"s{int(rng.integers(0, 3))}") for i in range(2000)]
    # Neither the middle name nor none of them is the end of an order that a number could give.
    data = [(*r, 100.0 * (r[2] == "birch") - 40.0 * (r[2] is None) + float(rng.normal(0, 0.1))) for r in data]
    df = spark.createDataFrame(data, "id long, a double, tree string, other string, y double")
    model = G.fit(df, ["a"], "y", "id", categories=["tree", "other"], trees=30, depth=6)
    assert model.categories == [("tree", ["ash", "birch", "cedar", "elm"]), ("other", ["s0", "s1", "s2"])]
    new = spark.createDataFrame([(1, 0.5, "birch", "s0"), (2, 0.5, "ash", "s1"), (3, 0.5, "elm", None), (4, None, "ash", "s0"), (5, 0.5, "birch", "new")], df.drop("y").schema)
    got = {r.id: r.prediction for r in G.predict(model, new).collect()}
    assert got[4] is None and got[1] > 80 and got[5] > 80 and abs(got[2]) < 30 and abs(got[3]) < 30
    one = G.fit(df.coalesce(1), ["a"], "y", "id", categories=["tree", "other"], trees=30, depth=6)
    assert (one.feature == model.feature).all() and (one.bound == model.bound).all()


def test_sums_by_category_are_those_of_columns_of_0_and_1():
    rng = np.random.default_rng(4)
    coded, codes = rng.integers(0, 9, (500, 2)).astype(np.uint8), rng.integers(0, 4, (500, 2)).astype(np.uint16)
    y, h = rng.normal(size=500), rng.integers(0, 1 << 62, 500).astype(np.uint64)
    split = np.arange(6).reshape(2, 3), np.zeros((2, 3), np.uint8), np.zeros((2, 7))
    one = G.Forest(["a", "b"], [], 2, *split, categories=[("c", ["x", "y", "z"]), ("d", ["u", "v", "w"])])
    two = G.Forest([*"abcdefgh"], [], 2, *split)
    asked = np.array([[[1, 3, 7], [0, 1, 5]], [[2, 4, 6], [0, 4, 7]]])
    found = []
    for model, parts in ((one, (coded, codes)), (two, (one.wide(coded, codes), None))):
        layout = G.Layout(model, asked)
        sums = [np.zeros((2, n)) for n in layout.start[:, -1]]
        G._tally(model, layout, asked, 1, *parts, y, h, 42, sums)
        found.append([layout.unfolded(side[layout.start[t, i] : layout.start[t, i + 1]], layout.n[t, i], asked[t, i]) for t in (0, 1) for i in (0, 1) for side in sums[t]])
    assert np.allclose(*found) and all(f.any(axis=1).all() for f in found[0])

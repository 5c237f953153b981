"""Near neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflux.operators import features as X
from dealflux.operators import near as N


def recall(spark, x, k=5, **options):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))
    got = {r.id: r.near for r in N.nearest(df, "id", [f"f{j}" for j in range(x.shape[1])], k, **options).collect()}
    hits = 0
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(1))
        d[i] = np.inf
        near = got[i]
        assert len({n.key for n in near}) == len(near) == min(k, len(x) - 1) and i not in {n.key for n in near}
        assert np.allclose([n.distance for n in near], d[[n.key for n in near]]) and all(a.distance <= b.distance for a, b in zip(near, near[1:]))
        hits += sum(n.distance <= np.partition(d, k - 1)[k - 1] + 1e-9 for n in near)
    return hits / (len(x) * k)


@pytest.mark.parametrize("d", [1, 3, 6])
def test_recall_of_the_true_five(spark, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 1, (2000, d)), rng.normal(4, 0.05, (500, d))])
    assert recall(spark, x) >= 0.9


def test_crowded_rows_and_ranges(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros((600, 2)), rng.normal(0, 1, (300, 2))])
    monkeypatch.setattr(N, "RANGE_ROWS", 50)
    assert recall(spark, x) >= 0.9


def test_few_rows_nulls_and_no_rows(make):
    rows = [(1, 0.0), (2, 1.0), (3, None), (4, float("nan")), (5, 5.0)]
    df = make(rows, "id long, a double")
    got = {r.id: [n.key for n in r.near] for r in N.nearest(df, "id", ["a"], 5).collect()}
    assert got == {1: [2, 5], 2: [1, 5], 5: [2, 1]}
    assert N.nearest(df.where("id = 3"), "id", ["a"], 5).count() == 0


def test_synthetic_rows_lie_between_true_neighbours(make):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(9, 0.1, (30, 2))])
    rows = [(i, 1, *map(float, r)) for i, r in enumerate(x)] + [(100 + i, 0, 0.0, float(i)) for i in range(200)]
    made = X.smote(make(rows, "id long, y int, a double, b double"), "y", "id", ["a", "b"]).where("is_synthetic = 1").toPandas()
    assert len(made) == 140 and not made.a.between(1, 8).any()  # none between the two groups

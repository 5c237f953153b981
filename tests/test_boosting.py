"""Multiclass boosting: planted structure, held-out loss, and sums that do not depend on the rows' order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealflux.operators import boosting as B
from dealflux.operators import features as X


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by hour and device, a tenth at random."""
    rng = np.random.default_rng(9)
    n = 3000
    hour, device = rng.integers(0, 24, n), rng.choice(["a", "b", "c"], n)
    kind = np.where(hour < 8, "night", np.where(device == "b", "work", "home"))
    kind = np.where(rng.random(n) < 0.1, rng.choice(["night", "work", "home"], n), kind)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "hour": hour, "device": device, "noise": rng.normal(size=n), "kind": kind}))
    return X.stratified_split(df, "kind", "id").persist()


FEATURES = ["hour", "device", "noise"]


def test_planted_structure_is_found(spark, rows):
    train, test = rows.where("not is_test"), rows.where("is_test")
    model = B.fit(train, FEATURES, "kind", rounds=20, depth=3, rate=0.3)
    assert model.classes == ["home", "night", "work"] and len(model.rounds) == 20
    scored = B.predict(model, test)
    row = B.log_loss(scored, model.classes, "kind").first()
    # What the generating chances themselves lose on these rows: 1/30 for each other kind.
    likely = F.when(F.col("hour") < 8, "night").when(F.col("device") == "b", "work").otherwise("home")
    best = test.agg(F.avg(-F.log(F.when(F.col("kind") == likely, 28 / 30).otherwise(1 / 30))).alias("loss")).first().loss
    assert row.accuracy > 0.9 and best - 0.02 < row.log_loss < best + 0.05
    top = B.top_classes(model, test.limit(50), "id", 2).toPandas()
    assert top.groupby("id").size().eq(2).all() and (top.sort_values(["id", "rank"]).groupby("id").prob.diff().dropna() <= 0).all()


def test_fit_does_not_depend_on_order_or_partitions(rows):
    one = B.fit(rows, FEATURES, "kind", rounds=3, depth=3)
    two = B.fit(rows.orderBy(F.desc("noise")).repartition(7), FEATURES, "kind", rounds=3, depth=3)
    for a, b in zip(one.rounds, two.rounds, strict=True):
        for x, y in zip(a, b, strict=True):
            assert all((u == v).all() for u, v in zip(x, y, strict=True))


def test_stored_margins_change_nothing(rows, monkeypatch):
    one = B.fit(rows, FEATURES, "kind", rounds=4, depth=2, rows=1.0)
    monkeypatch.setattr(B, "STORE_EVERY", 1)
    two = B.fit(rows, FEATURES, "kind", rounds=4, depth=2, rows=1.0)
    assert all((u == v).all() for a, b in zip(one.rounds, two.rounds) for x, y in zip(a, b) for u, v in zip(x[:2], y[:2]))


def test_first_split_equals_brute_force(spark):
    """One round of depth 1 against trying every threshold over plain rows."""
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 20, float)
    y = np.array(["p" if v <= 6 else "q" for v in x])
    y[::17] = "r"
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    model = B.fit(df, ["x"], "y", rounds=1, depth=1, rate=1.0, rows=1.0, columns=1.0)
    share = np.array([(y == c).mean() for c in model.classes])
    for k, c in enumerate(model.classes):
        g, h = share[k] - (y == c), np.full(len(y), 2 * share[k] * (1 - share[k]))
        gains = {t: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x <= t, x > t)) for t in np.unique(x)[:-1]}
        feature, bound, value = model.rounds[0][k]
        edge = model.bins[0][bound[0]]
        assert feature[0] == 0 and np.isclose(gains[edge], max(gains.values()))
        assert np.allclose(value[1:3], [-g[s].sum() / (h[s].sum() + 1) for s in (x <= edge, x > edge)], atol=1e-4)


def test_nulls_unknown_categories_and_one_class(make):
    rows = [(i, None if i % 5 == 0 else float(i % 3), ["u", "v", None][i % 3], ["k", "l"][i % 3 == 0] if i % 7 else None) for i in range(120)]
    df = make(rows, "id long, a double, b string, y string")
    model = B.fit(df, ["a", "b"], "y", rounds=2, depth=2)
    new = make([(1, None, "never seen", None), (2, float("nan"), None, None)], "id long, a double, b string, y string")
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in B.predict(model, new).collect())
    alone = B.fit(df.where("y = 'k'"), ["a", "b"], "y", rounds=1, depth=2)
    assert B.predict(alone, new).first().prediction == "k"
    with pytest.raises(ValueError, match="no row has"):
        B.fit(df.where("y is null"), ["a"], "y", rounds=1)


def test_weighted_loss_is_that_of_the_rows(spark):
    rows = [("x", [0.7, 0.3], 3), ("y", [0.6, 0.4], 2), ("z", [0.5, 0.5], 1)]
    cells = B.likeliest(spark.createDataFrame(rows, "kind string, probability array<double>, n int"), ["x", "y"])
    one = B.log_loss(cells, ["x", "y"], "kind", weight="n").first()
    two = B.log_loss(cells.withColumn("_", F.explode(F.sequence(F.lit(1), "n"))), ["x", "y"], "kind").first()
    assert one.rows == two.rows == 6 and one.accuracy == two.accuracy == 0.5 and abs(one.log_loss - two.log_loss) < 1e-12

"""Kernels against brute force on small tables, with groups forced over their large-group paths."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dealflux.plans import kernels as K
from dealflux.plans import ordered as O


@pytest.fixture(scope="module")
def log(spark):
    """One user holds a third of the rows; some time stamps tie."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        user = 1 if i % 3 == 0 else rng.randint(2, 40)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 9000))
        rows.append((i, user, at, rng.choice("abcd")))
    rows += [(1000, None, dt.datetime(2024, 1, 2), "a")]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, kind string")


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("seconds", [60, 3600, 10**7])
def test_neighbours_equal_plain_window(log, n, backwards, seconds):
    got = O.neighbours(log, ["user_id"], ["ts", "event_id"], ["kind"], n=n, backwards=backwards, chunk=O.chunk_of("ts", seconds), out="x")
    got = {r.event_id: [i.kind for i in r.x] for r in got.collect()}
    shift = F.lag if backwards else F.lead
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cols = F.array_compact(F.array(*[shift("kind", i).over(w) for i in range(1, n + 1)]))
    want = {r.event_id: list(r.x) for r in log.where("user_id is not null").withColumn("x", cols).collect()}
    assert got == want


@pytest.mark.parametrize("gap", [600, 7200])
def test_sessionize_equals_running_sum(log, gap):
    got = {r.event_id: r.session_no for r in O.sessionize(log, gap_seconds=gap).collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > gap * 1_000_000, 1).otherwise(0)
    plain = log.where("user_id is not null").withColumn("new", new).withColumn("n", F.sum("new").over(w))
    assert got == {r.event_id: r.n for r in plain.collect()}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "b", "c"], 3000), "v": np.round(rng.lognormal(3, 2, 3000), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one", "two", "two"], "v": [4.0, 1.0, 2.0]})])
    df = spark.createDataFrame(pdf)
    probs = {"p0": 0.0, "p1": 0.25, "p2": 0.5, "p3": 0.9, "p4": 1.0}
    got = K.exact_percentiles(df, ["g"], "v", probs, accuracy).toPandas().set_index("g")
    for name, p in probs.items():
        want = pdf.groupby("g").v.quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index())
        near = K.exact_percentiles(df, ["g"], "v", {name: p}, accuracy, bounded=True).toPandas().set_index("g")
        assert np.allclose(near[name].sort_index(), want.sort_index())
    whole = K.exact_percentiles(df, [], "v", probs, accuracy).first()
    assert np.allclose([whole[n] for n in probs], [pdf.v.quantile(p) for p in probs.values()])


def test_percentiles_of_nothing_and_nulls(make):
    df = make([("a", None), ("a", 1.0), ("b", None), (None, 3.0)], "g string, v double")
    assert [tuple(r) for r in K.exact_percentiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 1.0)]
    d = K.describe(df.where("g = 'b'"), [], "v").first()
    assert (d.n, d["mean"], d["median"]) == (0, None, None)


def test_mode_ties_and_null_keys(make):
    df = make([("x", "b"), ("x", "a"), ("y", "c"), ("y", None), (None, "z")], "g string, v string")
    assert sorted(map(tuple, K.mode_by(df, ["g"], "v").collect())) == [("x", "a"), ("y", "c")]


def test_null_keys_are_dropped_and_all_null_sums_are_zero(make):
    from dealflux.functions.columns import total

    df = make([("a", None), ("a", None), (None, 2.0)], "g string, v double")
    assert [tuple(r) for r in K.aggregate_by(df, ["g"], s=total("v"), n=F.count("v"), m=F.count(F.lit(1))).collect()] == [("a", 0.0, 0, 2)]


def test_share_growth_and_grid(make):
    df = make([(1, "a", 0), (2, "a", 4), (4, "a", 6), (1, "b", 2)], "y int, k string, n long")
    shares = K.share_of(df, "n", ["k"]).collect()
    assert sum(r.share for r in shares if r.k == "a") == pytest.approx(100)
    grown = {(r.y, r.k): r.g for r in K.growth(df, ["k"], "y", "n", "g").collect()}
    assert grown[(2, "a")] is None and grown[(4, "a")] == pytest.approx(50)
    grid = {(r.y, r.k): r.n for r in K.grid_fill(df, df.select("y"), "k", K.values_array(df, "k"), {"n": 0}).collect()}
    assert grid == {(1, "a"): 0, (1, "b"): 2, (2, "a"): 4, (2, "b"): 0, (4, "a"): 6, (4, "b"): 0}
    assert K.share_of(make([("a", 0), ("b", 0)], "k string, n long"), "n").first().share is None


def test_range_rank_is_dense_rank(spark):
    names = [f"{random.Random(i).choice('abc')}{i % 37:02d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "v string")
    got = {r.v: r.id for r in K.range_rank(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(names)))}


def test_calendar_fills_gap_months(make):
    from dealflux.operators.series import bucketed

    df = make([("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 4, 1), 2.0), ("b", dt.date(2020, 2, 1), None)], "k string, d date, v double")
    got = {(r.k, r.bucket.month): r.value for r in bucketed(df, "d", "v", keys=["k"]).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.0, ("a", 3): 0.0, ("a", 4): 2.0, ("b", 2): 0.0}


def test_results_do_not_depend_on_partitions(spark, tables):
    from dealflux.operators.sequences import sliding_windows

    found = []
    for n in ("3", "11"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, sliding_windows(tables.web_events.repartition(int(n)), 3, per_session=1).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]

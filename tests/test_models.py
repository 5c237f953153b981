"""Models and forecasts: planted truth and invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from dealflux.operators import features as X
from dealflux.operators import forecasting as Y
from dealflux.operators import hidden_states as H
from dealflux.operators import models as M


@pytest.fixture(scope="module")
def chains(spark):
    """Sessions of two hidden states with codes near 0 and near 5; one session holds a third of the rows."""
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for s in range(40):
        state, length = rng.integers(2), 300 if s == 0 else int(rng.integers(1, 30))
        for i in range(length):
            state = state if rng.random() < 0.8 else 1 - state
            rows.append((n, f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float(rng.normal(5 * state, 0.7)), int(state)))
            n += 1
    return spark.createDataFrame(rows, "event_id long, session_id string, event_time timestamp, code double, truth int").persist()


def test_hidden_states_do_not_depend_on_segments(spark, chains):
    fits, paths = [], []
    for seconds, longest in ((1800, 65_536), (10**7, 65_536), (10**7, 7)):
        segs = H.segments(chains, "code", seconds=seconds, longest=longest).persist()
        assert segs.agg(F.max(F.size("obs"))).first()[0] <= longest
        h = H.fit(segs, states=2, max_iter=6, tol=0)
        fits.append(np.concatenate([h.start, h.trans.ravel(), h.mean, h.var, h.loglik]))
        paths.append({r.event_id: r.state for r in H.decode(segs, h).collect()})
    assert np.allclose(fits[0], fits[1], rtol=1e-6) and np.allclose(fits[0], fits[2], rtol=1e-6)
    assert paths[0] == paths[1] == paths[2] and len(paths[0]) == chains.count()
    assert all(b >= a - 1e-6 for a, b in zip(h.loglik, h.loglik[1:]))
    assert np.allclose(h.mean, [0, 5], atol=0.3) and np.allclose(np.diag(h.trans), 0.8, atol=0.08)
    truth = {r.event_id: r.truth for r in chains.collect()}
    assert np.mean([paths[0][k] == truth[k] for k in truth]) > 0.97


def test_equal_sessions_are_one_weighted_sequence(spark, monkeypatch):
    """A fit reads different sequences only; it equals the fit over every session's segments, long sessions included."""
    kinds = [[0, 0, 1, 4], [4, 4, 3, 4, 0], [1], [0, 1] * 20]
    rows = [
        (1000 * s + i, f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=40 * i + 7 * s), float(c))
        for s in range(60) for i, c in enumerate(kinds[min(s % 5, 3)])
    ]
    segs = H.segments(spark.createDataFrame(rows, "event_id long, session_id string, event_time timestamp, code double"), "code").persist()
    assert segs.count() > 60
    whole, long = H.sequences(segs)
    assert sorted((len(r.obs), r.weight) for r in whole.collect()) == [(1, 12), (4, 12), (5, 12), (40, 24)] and long.count() == 0
    fits = []
    for events in (4096, 10, 0):
        monkeypatch.setattr(H, "WHOLE", events)
        h = H.fit(segs, states=2, max_iter=4, tol=0)
        fits.append(np.concatenate([h.start, h.trans.ravel(), h.mean, h.var, h.loglik]))
    assert H.sequences(segs)[0].count() == 0
    assert np.allclose(fits[0], fits[1], rtol=1e-9) and np.allclose(fits[0], fits[2], rtol=1e-9)


@pytest.mark.parametrize("width", [2, 3, 64])
def test_one_session_of_many_segments_is_many_runs(spark, monkeypatch, width):
    """Tree or chain: the same fit, path and last states; 300 segments of one event in the longest session."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for s, length in enumerate([300, 1, 2, 7, 8, 9]):
        for i in range(length):
            rows.append((n, f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(rng.normal(5 * (i // 3 % 2), 0.7))))
            n += 1
    segs = H.segments(spark.createDataFrame(rows, "event_id long, session_id string, event_time timestamp, code double"), "code", seconds=10**7, longest=1).persist()
    assert segs.agg(F.max("segments")).first()[0] == 300
    ends = {}
    for w in (10**6, width):
        monkeypatch.setattr(H, "WIDTH", w)
        h = H.fit(segs, states=2, max_iter=4, tol=0)
        path = {r.event_id: r.state for r in H.decode(segs, h).collect()}
        last = {r.session_id: r.state for r in H.next_of_sessions(segs, h, 3).where("rank = 1").collect()}
        ends[w] = (np.concatenate([h.start, h.trans.ravel(), h.mean, h.var, h.loglik]), path, last)
    assert np.allclose(ends[10**6][0], ends[width][0], rtol=1e-6) and ends[10**6][1:] == ends[width][1:] and len(path) == n
    final = {r[1]: r[0] for r in rows}
    assert last == {s: path[i] for s, i in final.items()}
    ms = segs.mapInPandas(H.segment_matrix(h, False), H.MATRICES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would else be one task again
    try:
        assert H.in_runs(ms).where("owner = 's0'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_decode_is_the_best_path(spark, chains):
    segs = H.segments(chains.where("session_id in ('s1', 's2', 's3')"), "code", seconds=1800)
    h = H.Hidden(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([1.0, 4.0]), np.array([2.0, 2.0]), [])
    got = {r.event_id: r.state for r in H.decode(segs, h).collect()}
    for session in ("s1", "s2", "s3"):
        rows = chains.where(F.col("session_id") == session).orderBy("event_time").collect()
        logb = np.log(H.densities(np.array([[r.code for r in rows]]), h))[0]
        score, back = np.log(h.start) + logb[0], []
        for b in logb[1:]:
            cand = score[:, None] + np.log(h.trans)
            back.append(cand.argmax(0))
            score = cand.max(0) + b
        path = [int(score.argmax())]
        for pointer in back[::-1]:
            path.append(int(pointer[path[-1]]))
        assert [got[r.event_id] for r in rows] == path[::-1]


def test_whole_sessions_joins_batches():
    frames = [pd.DataFrame({"session_id": list(t), "i": range(len(t))}) for t in ("aab", "bbb", "bcc", "d")]
    out = [sorted(set(f.session_id)) for f in H.whole_sessions(iter(frames))]
    assert sum(out, []) == ["a", "b", "c", "d"]


def test_code_mass_sums_to_one():
    h = H.Hidden(np.ones(2) / 2, np.ones((2, 2)) / 2, np.array([0.3, 2.0]), np.array([1.0, 0.2]), [])
    assert np.allclose(H.code_mass(h, 4).sum(1), 1)


def test_smote_balances_inside_the_segment(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (97, 2)))]
    rows += [(200 + i, 1, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(5, 1, (20, 2)))]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = X.smote(df, "y", "id", ["a", "b"]).toPandas()
    assert (out.y == 0).sum() == 97 and (out.y == 1).sum() == 97
    real, made = out[(out.y == 1) & (out.is_synthetic == 0)], out[out.is_synthetic == 1]
    assert made.a.between(real.a.min(), real.a.max()).all() and made.b.between(real.b.min(), real.b.max()).all()
    assert made.groupby("id").size().between(3, 4).all()


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    model, cost = M.kmeans(df, ["a", "b"], k=3, seeds=3)
    labelled = M.assign(model, df, ["a", "b"])
    assert sorted(r.size for r in M.cluster_centres(labelled, ["a", "b"]).collect()) == [30, 30, 30]
    quality = M.cluster_quality(labelled, ["a", "b"]).first()
    assert quality.inertia == pytest.approx(cost, rel=1e-6) and quality.davies_bouldin < 0.1 and M.silhouette(labelled, ["a", "b"]) > 0.95
    assert sum(r.importance for r in M.cluster_importance(labelled, ["a", "b"]).collect()) == pytest.approx(1)


def test_seeded_fits_run_side_by_side(spark, monkeypatch):
    """Three fits meet before any begins; the best of them is the best of the same fits made one by one."""
    import threading

    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(200, 2))], "a double, b double").persist()
    data = M.assembler(["a", "b"]).transform(df)
    costs = [M.KMeans(k=4, seed=M.SEED + i, maxIter=300, tol=1e-4).fit(data).summary.trainingCost for i in range(3)]
    met = threading.Barrier(3)

    class Meeting(M.KMeans):
        def fit(self, dataset):
            met.wait(60)
            return super().fit(dataset)

    monkeypatch.setattr(M, "KMeans", Meeting)
    assert M.kmeans(df, ["a", "b"], k=4, seeds=3)[1] == pytest.approx(min(costs))


def test_folds_read_stored_rows(spark):
    """Every row's making is counted: once for all five folds."""
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    df = spark.range(400).select("id", (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 13 * 2.0 + F.col("id") % 3).alias("y"))
    counted = df.mapInPandas(mark, "id long, a double, y double")
    folds = M.cross_validated(counted, "y", "id", lambda part: M.elastic_net(part, ["a"], "y")).collect()
    assert sum(r.held_out for r in folds) == 400 and len(folds) == 5 and made.value == 400


def test_auc_of_perfect_and_tied_scores(make):
    best = make([(1, 1, 0.9), (0, 0, 0.1), (1, 1, 0.8)], "label int, prediction int, score double")
    assert M.classification_metrics(best).first().auc == 1.0
    tied = make([(1, 1, 0.5), (0, 1, 0.5)], "label int, prediction int, score double")
    row = M.classification_metrics(tied).first()
    assert (row.auc, row.accuracy, row.recall) == (0.5, 0.5, 1.0)


def test_mape_leaves_zero_labels_out(make):
    row = M.regression_metrics(make([(0.0, 1.0), (2.0, 1.0)], "label double, prediction double")).first()
    assert row.mape == pytest.approx(50) and row.mse == pytest.approx(1)


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4).alias("y"))
    one = X.stratified_split(df, "y", "id")
    assert one.exceptAll(X.stratified_split(df.repartition(7), "y", "id")).count() == 0
    assert all(abs(r.share - 0.2) < 0.04 for r in one.groupBy("y").agg(F.avg(F.col("is_test").cast("int")).alias("share")).collect())


def series_of(spark, values, step="D", name="s"):
    when = pd.date_range("2020-01-01", periods=len(values), freq=step)
    return spark.createDataFrame(pd.DataFrame({"series": name, "bucket": when, "value": np.asarray(values, dtype=float)}))


def test_autoregression_is_recovered(spark):
    rng = np.random.default_rng(8)
    x = [0.0]
    for e in rng.normal(0, 1, 800):
        x.append(0.7 * x[-1] + e)
    s = series_of(spark, x)
    fit = Y.ar_fit(s).first()
    assert fit.d == 0 and fit.p >= 1
    assert Y.stationarity(s).first().d == 0
    assert Y.ar_fit(s, max_p=1, max_q=0).first().ar[0] == pytest.approx(0.7, abs=0.06)
    acf = {r.lag: r.acf for r in Y.acf(s).collect()}
    assert acf[0] == pytest.approx(1) and acf[1] == pytest.approx(0.7, abs=0.08) and max(acf) == 40
    order = Y.orders(Y.acf(s)).where("lag = 1").first()
    assert order.pacf == pytest.approx(acf[1]) and order.p >= 1
    walk = series_of(spark, np.cumsum(rng.normal(0, 1, 300)))
    ahead = Y.ar_forecast(walk, horizon=5, step="day").orderBy("h").collect()
    assert Y.ar_fit(walk).first().d == 1
    assert all(r.lower < r.yhat < r.upper for r in ahead)
    assert [b.se >= a.se for a, b in zip(ahead, ahead[1:])] == [True] * 4
    assert ahead[0].bucket == dt.datetime(2020, 10, 27)


def test_constant_and_short_series(spark):
    assert Y.ar_forecast(series_of(spark, [3.0] * 40), horizon=2, step="day").first().yhat == pytest.approx(3.0)
    short = Y.ar_fit(series_of(spark, [1.0, 2.0])).first()
    assert short.reason == Y.SHORT and short.ar == []
    ahead = Y.ar_forecast(series_of(spark, [4.0]), horizon=2, step="day").collect()
    assert [(r.h, r.yhat, r.reason) for r in ahead] == [(1, 4.0, Y.SHORT), (2, 4.0, Y.SHORT)]
    line = Y.seasonal_trend(series_of(spark, [1.0, 2.0, 3.0], "h"), horizon=1)
    assert line.where("kind = 'forecast'").first().yhat == pytest.approx(4.0, abs=0.1)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_seasonal_trend_is_recovered(spark, mode):
    t = np.arange(24 * 28)
    wave = np.sin(2 * np.pi * t / 24)
    y = 10 + 0.01 * t + 2 * wave if mode == "additive" else (10 + 0.01 * t) * (1 + 0.2 * wave)
    out = Y.seasonal_trend(series_of(spark, y, "h"), horizon=24, mode=mode).toPandas()
    fit, ahead = out[out.kind == "fit"], out[out.kind == "forecast"]
    assert np.abs(fit.yhat - fit.y).mean() < 0.15
    u = np.arange(len(t), len(t) + 24)
    w = np.sin(2 * np.pi * u / 24)
    want = 10 + 0.01 * u + 2 * w if mode == "additive" else (10 + 0.01 * u) * (1 + 0.2 * w)
    assert np.abs(ahead.sort_values("bucket").yhat.to_numpy() - want).mean() < 0.5
    assert (ahead.lower <= ahead.yhat).all() and (out[out.kind == "changepoint"].shape[0]) == 10


def test_next_event_backoff_uses_longest_known_context(make):
    from dealflux.operators import sequences as Q

    base = dt.datetime(2024, 1, 1)
    rows = [(i, "s", base + dt.timedelta(seconds=i), k) for i, k in enumerate("abcabd")]
    df = make(rows, "event_id long, session_id string, event_time timestamp, event_type string")
    table = Q.next_event_backoff(df, 2)
    cases = make([(1, ["c", "a", "b"]), (2, ["x", "a"]), (3, ["x"])], "case_id int, events array<string>")
    got = {(r.case_id, r.rank): (r.length, r.next_event, r.prob) for r in Q.predict_backoff(table, cases, 2).collect()}
    assert got[(1, 1)] == (2, "c", 0.5) and got[(2, 1)] == (1, "b", 1.0) and not any(c == 3 for c, _ in got)


def test_saved_model_scores_the_same(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    model = M.random_forest_classifier(df, ["a"], "y", trees=5, depth=4)
    M.save(model, str(tmp_path / "m"))
    assert M.score(M.load(str(tmp_path / "m")), df).exceptAll(M.score(model, df)).count() == 0
    assert sum(r.importance for r in M.feature_importance(model, ["a"], spark).collect()) == pytest.approx(1)


def test_p_value_of_known_t(make):
    from dealflux.operators.sessions import ttest_p_values

    rows = ttest_p_values(make([(1.959964,), (0.0,), (-2.575829,)], "t double")).collect()
    assert [r.p_value for r in rows] == pytest.approx([0.05, 1.0, 0.01], abs=1e-6)


def test_hidden_markov_queries_use_the_default_fit(spark, monkeypatch):
    from dealflux.catalog import learning_queries  # noqa: F401
    from dealflux.catalog.registry import QUERIES

    given = []

    def fit(segs, **options):
        given.append(options)
        return H.initial(segs, 5)

    monkeypatch.setattr(H, "fit", fit)
    assert QUERIES["ml_hmm_em"](spark, DATA).count() == 25
    assert QUERIES["ml_hmm_decode"](spark, DATA).count() > 0
    assert given == [{}, {}]


def _walk(rng, n, root):
    y, e = [0.0], rng.normal(size=n)
    for v in e:
        y.append(root * y[-1] + v)
    return y[1:]


def _augmented(y, most):
    """Lags, t and slope by fitting every order with numpy on the rows that all orders share."""
    y = np.asarray(y)
    dy = np.diff(y)
    best = None
    for lags in range(most + 1):
        rows = range(most, len(dy))
        x = np.array([[1.0, y[i], *[dy[i - k] for k in range(1, lags + 1)]] for i in rows])
        target = dy[most:]
        coef = np.linalg.lstsq(x, target, rcond=None)[0]
        rss = float(((target - x @ coef) ** 2).sum())
        aic = len(target) * np.log(rss / len(target)) + 2 * (2 + lags)
        if best is None or aic < best[0]:
            se = np.sqrt(rss / (len(target) - 2 - lags) * np.linalg.inv(x.T @ x)[1, 1])
            best = (aic, lags, coef[1], coef[1] / se)
    return best[1:]


def test_unit_root_lags_and_p_values(spark):
    rng = np.random.default_rng(4)
    known = {"walk": _walk(rng, 200, 1.0), "still": _walk(rng, 200, 0.3), "slow": _walk(rng, 90, 0.9)}
    known["lagged"] = np.convolve(_walk(rng, 150, 0.5), [1, 0.8, 0.6])[2:150].tolist()
    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v)) for k, ys in known.items() for i, v in enumerate(ys)]
    rows += [("flat", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 2.0) for i in range(50)] + [("one", dt.datetime(2020, 1, 1), 1.0), ("none", dt.datetime(2020, 1, 1), None)]
    got = {r.series: r for r in Y.unit_root(spark.createDataFrame(rows, "series string, bucket timestamp, value double")).collect()}
    for name, ys in known.items():
        most = min(16, int(np.ceil(12 * ((len(ys) - 1) / 100) ** 0.25)), (len(ys) - 1) // 2 - 2)
        lags, slope, t = _augmented(ys, most)
        assert got[name].lags == lags and np.isclose(got[name].t, t) and np.isclose(got[name].slope, slope) and got[name].n == len(ys) - 1 - most
    assert got["still"].d == 0 and got["still"].p_value < 0.01 and got["walk"].d == 1 and got["walk"].p_value > 0.05
    assert all(got[k].t is None and got[k].d == 1 for k in ("flat", "one", "none"))


def test_p_values_at_published_points():
    # 1 %, 5 % and 10 % points of the large-sample distribution with a constant.
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert abs(Y.p_value(t) - p) < 0.002
    assert Y.p_value(-30) == 0 and Y.p_value(5) == 1
    ts = np.linspace(-6, 2.7, 80)
    assert (np.diff([Y.p_value(t) for t in ts]) > 0).all()


def test_two_bends_are_two(spark):
    rng = np.random.default_rng(6)
    u = np.arange(800) / 799
    knots = [0.8 * (i + 1) / 11 for i in range(10)]
    shapes = {"two": 5 * u + 30 * np.maximum(u - knots[2], 0) - 50 * np.maximum(u - knots[7], 0), "none": 4 - 3 * u}
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v + np.sin(i / 24 * 2 * np.pi) + rng.normal(0, 0.3))) for k, ys in shapes.items() for i, v in enumerate(ys)]
    rows += [("short", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(3)] + [("flat", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0) for i in range(60)]
    got = Y.changepoints(Y.seasonal_trend(spark.createDataFrame(rows, "series string, bucket timestamp, value double"))).orderBy("bucket").collect()
    changed = {k: [i for i, r in enumerate(r for r in got if r.series == k) if r.slope_change != 0.0] for k in ("two", "none", "short", "flat")}
    assert changed == {"two": [2, 7], "none": [], "short": [], "flat": []}
    sizes = [r.slope_change * 799 / 24 for r in got if r.series == "two" and r.slope_change]
    assert np.allclose(sizes, [30, -50], rtol=0.1)


def test_moments_are_one_aggregate(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(f"s{i % 3}", r.tolist()) for i, r in enumerate(x)], "k string, x array<double>")
    sums = Y.gram(df, ["k"], "x", 4)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    for r in sums.collect():
        own = x[int(r.k[1]) :: 3]
        assert r.rows == len(own) and np.allclose(np.reshape(r.gram, (4, 4)), own.T @ own)


def test_examples_count_the_rounds_before(make):
    """Rounds of one week and of several, of unknown amount too; a deal of unknown type is no round, equal rows count alike."""
    day = lambda d: dt.date(2024, 1, d)
    deals = [(1, 7, day(1), 1.0, "Seed"), (2, 7, day(2), None, "Seed"), (3, 7, day(2), 3.0, None), (4, 7, day(3), 4.0, "Series A"), (5, 7, day(20), 5.0, "Grant"),
             (6, 7, None, 6.0, "Seed"), (7, 8, day(20), 7.0, "Seed"), (8, None, day(20), 8.0, "Seed"), (9, 8, day(21), 9.0, "Seed"), (9, 8, day(21), 9.0, "Seed"), (10, 8, day(22), 1.0, "Seed")]
    deals = make(deals, "id long, company_id long, date date, amount double, round_type string")
    companies = make([(7, "here", "a-1", None), (8, None, None, day(1))], "id long, ecosystem_name string, primary_tag string, date_founded date")
    got = sorted((r.id, r.previous_rounds) for r in X.next_round_examples(deals, companies, counted=True).collect())
    assert got == [(1, 1), (4, 3), (5, 4), (6, 0), (7, 0), (9, 1), (9, 1), (10, 3)]
    plain = X.next_round_examples(deals, companies)
    assert "previous_rounds" not in plain.columns and plain.count() == len(got)


def test_round_forest_learns_from_rounds_places_and_sectors(spark, tmp_path, monkeypatch):
    from dealflux.catalog import learning_queries, registry

    registry.load()
    at = dt.datetime(1995, 1, 1)
    made = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "HERE", 0), (1, "THERE", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"c{i}", i % 2, 0.0, ["AUTO", "BIO"][i // 2 % 2]) for i in range(1, 9)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, i % 8 + 1, "O", 10.0 * i, at + dt.timedelta(days=i), "1") for i in range(1, 200)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    fit, seen = learning_queries.G.fit, []
    monkeypatch.setattr(learning_queries.G, "fit", lambda *a, **kw: seen.append(fit(*a, **kw, trees=3, depth=3)) or seen[-1])
    out = registry.QUERIES["ml_regressor_random_forest"](spark, str(tmp_path)).collect()
    assert {"round_ordinal", "previous_rounds", "age_at_deal", "weekday", "month"} <= set(seen[0].features)
    assert seen[0].categories == [("ecosystem_name", ["HERE", "THERE"]), ("sector_group", ["AUTO", "BIO"])]
    assert len(out) == 199 - 2 - 2 and all(r.prediction is not None for r in out)

"""Semantics that differ between data frames in memory and SQL, one small table each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators import cleaning, filters, investing, profile, projections, sequences, series, sessions
from dealflux.operators import deals as D
from dealflux.operators import features as X

T0 = dt.datetime(2024, 1, 1)


def events(make, rows):
    """(user, session, minutes after midnight, type) rows."""
    data = [(i, u, s, T0 + dt.timedelta(minutes=m), k) for i, (u, s, m, k) in enumerate(rows)]
    return make(data, "event_id long, user_id long, session_id string, event_time timestamp, event_type string")


def test_bins_are_right_closed_and_lowest_is_open(make):
    df = make([(0.0,), (1e5,), (1e5 + 1,), (2e8,), (None,), (-1.0,)], "amount double")
    assert [r[0] for r in projections.deal_size(df).select("deal_size").collect()] == [None, "<100K", "100K-500K", "100M+", None, None]
    million = projections.deal_size_millions(make([(-3.0,), (5e6,), (5e6 + 1,), (None,)], "amount double"))
    assert [r.size_class for r in million.collect()] == ["$0-5M", "$0-5M", "$5-15M", None]


def test_hour_zero_has_no_daytime(make):
    df = make([(0,), (6,), (7,), (23,)], "h int")
    assert [r[0] for r in df.select(projections.daytime(F.col("h"))).collect()] == ["nan", "night", "morning", "evening"]
    assert df.select(projections.daytime(F.col("h"), include_lowest=True)).first()[0] == "night"


def test_weekday_starts_on_monday(make):
    row = projections.time_features(events(make, [(1, "a", 0, "x")])).first()
    assert (row.weekday, row.day_of_week, row.year_month) == (0, "Monday", "2024-01")


def test_device_filter_and_nulls(make):
    df = make([("iOS",), ("Linux",), (None,)], "device_family string")
    assert filters.exclude(df).count() == 1
    assert filters.exclude(df, keep_null=True).count() == 2


def test_null_group_kept_only_where_the_source_keeps_it(make):
    from dealflux.operators.activity import country_metrics

    df = make([("s", 1, None), ("s", 1, "A")], "session_id string, user_id long, country string")
    assert country_metrics(df).count() == 2
    assert profile.value_counts(df, "country").count() == 1


def test_division_by_zero_gives_null(make):
    row = make([(1.0, 0.0)], "a double, b double").select(C.ratio("a", "b").alias("x"), C.change("a", "b").alias("y")).first()
    assert row.x is None and row.y is None


def test_funnel_with_absent_step_and_modes(make):
    df = events(make, [(1, "a", 1, "view"), (1, "a", 2, "buy"), (2, "b", 1, "buy"), (2, "b", 5, "view"), (None, "c", 1, "view")])
    independent = {r.step: (r.users, r.conversion) for r in sequences.funnels(df, {"f": ["view", "gone", "buy"]}).collect()}
    assert independent == {1: (2, 100.0), 2: (0, 0.0), 3: (2, None)}
    ordered = {r.step: r.users for r in sequences.funnels(df, {"f": ["view", "buy"]}, mode="ordered").collect()}
    assert ordered == {1: 2, 2: 1}


def test_user_pairs_count_the_terminal_event(make):
    df = events(make, [(1, "a", 1, "x"), (1, "a", 2, "y"), (2, "b", 1, "y")])
    assert {r.pair: r.n for r in sequences.user_pairs(df).collect()} == {"x -> y": 1, "y -> nan": 2}
    assert {r.pair for r in sequences.user_pairs(df, include_terminal=False).collect()} == {"x -> y"}


def test_seconds_since_previous_not_to_next(make):
    df = events(make, [(1, "a", 1, "x"), (1, "a", 3, "y")])
    assert {r.event_type: r.secs_since_prev for r in sequences.seconds_since_previous(df).collect()} == {"x": None, "y": 120.0}


def test_equal_time_stamps_order_by_event_id(make):
    df = events(make, [(1, "a", 5, "x"), (1, "a", 5, "y"), (1, "a", 5, "z")])
    assert {r.event_type: r.next_event_type for r in sequences.next_event(df).collect()} == {"x": "y", "y": "z", "z": None}


def test_markov_probabilities_sum_to_one(tables):
    sums = sequences.markov(tables.web_events).groupBy("src").agg(F.sum("prob").alias("p")).collect()
    assert sums and all(r.p == pytest.approx(1.0) for r in sums)


def test_ngrams_and_flow(make):
    df = events(make, [(1, "a", 1, "a:b"), (1, "a", 2, "c_d"), (1, "a", 3, "a:b"), (1, "a", 4, "c_d")])
    grams = {(r.length, r.sequence): r.n for r in sequences.ngrams(df, (2, 3)).collect()}
    assert grams == {(2, "a:b → c_d"): 2, (2, "c_d → a:b"): 1, (3, "a:b → c_d → a:b"): 1, (3, "c_d → a:b → c_d"): 1}
    flow = sequences.flow_edges(sequences.ngrams(df, (2,))).collect()
    assert ("A B", "C D", 2) in {(r.source, r.target, r.weight) for r in flow}


def test_sliding_windows_keep_a_seeded_limit(make):
    df = events(make, [(1, "a", i, f"k{i}") for i in range(40)] + [(2, "b", i, "x") for i in range(3)])
    kept = sequences.sliding_windows(df, 3, per_session=25).collect()
    assert len(kept) == 25 and all(len(r.events) == 3 for r in kept)
    assert sequences.sliding_windows(df, 3, per_session=None).count() == 37


def test_single_event_sessions(make):
    df = events(make, [(1, "a", 1, "x"), (1, "b", 1, "end"), (1, "b", 2, "end"), (1, "c", 1, "x"), (1, "c", 2, "end")])
    assert {r.session_id for r in filters.drop_single_event_sessions(df).collect()} == {"b", "c"}
    assert {r.session_id for r in filters.drop_sessions_of_only(df, "end").collect()} == {"a", "c"}
    assert {r.session_id: r.seconds for r in sessions.session_spans(df).collect()}["a"] == 0.0


def test_zscore_of_a_constant_column_is_null(make):
    rows = cleaning.with_zscore(make([(2.0,), (2.0,)], "v double"), "v").collect()
    assert [r.zscore for r in rows] == [None, None]


def test_region_fill_by_city_then_overall(make):
    df = make([("c1", "r1"), ("c1", None), ("c2", None), (None, None), ("c3", "r1")], "city string, region string")
    assert {r.region for r in cleaning.fill_region_by_city(df).collect()} == {"r1"}


def test_standard_deviations(make):
    df = make([(1.0,), (3.0,)], "v double")
    assert profile.numeric_describe(df, ["v"]).first()["std"] == pytest.approx(2**0.5)
    assert sorted(r.v_z for r in X.standardize(df, ["v"]).collect()) == [-1.0, 1.0]


def test_winsor_bounds_are_fitted_state(make):
    train = make([(float(i),) for i in range(1, 10)], "v double")
    bounds = X.winsor_bounds(train, ["v"])
    new = X.winsorize(make([(1000.0,), (float("inf"),), (None,), (5.0,)], "v double"), bounds, ["v"])
    assert [r.v for r in new.collect()] == [13.0, None, None, 5.0]


def test_success_threshold_max_is_never_passed(make):
    f = make([(1, 5.0), (2, 7.0), (3, 9.0)], "company_id long, total_funding double")
    assert {r.is_successful for r in projections.success_flag(f).collect()} == {0}
    assert [r.is_successful for r in projections.success_flag(f, threshold="median").orderBy("company_id").collect()] == [0, 0, 1]


def test_appearance_ids(make):
    df = make([(5, "b"), (1, "z"), (7, "a"), (9, None), (3, "b")], "id long, tag string")
    assert {(r.tag, r.n) for r in X.appearance_ids(df, "tag", "id", "n").collect()} == {("z", 0), ("b", 1), ("a", 2), (None, -1)}


def test_empty_size_bins_appear(make):
    df = make([(1, 2020, 50.0)], "id long, year int, amount double")
    rows = {r.deal_size: (r.deals, r.amount_sum, r.amount_mean) for r in D.size_trends(df).collect()}
    assert len(rows) == 8 and rows["100M+"] == (0, 0.0, None) and rows["<100K"] == (1, 50.0, 50.0)


def test_monthly_returns_of_zero_and_gap(make):
    d = dt.date
    df = make([(1, d(2020, 1, 1), 4.0), (1, d(2020, 3, 1), 2.0), (2, d(2020, 2, 1), None)], "company_id long, date date, amount double")
    got = {(r.company_id, r.month.month): r.change for r in series.monthly_returns(df).collect()}
    assert got == {(1, 1): 0.0, (1, 2): -1.0, (1, 3): None}


def test_rolling_mean_is_null_until_full(make):
    df = make([("a", i, float(i)) for i in range(4)], "k string, bucket int, value double")
    assert [r.mean_3 for r in series.rolling_means(df, ["k"], windows=[3]).orderBy("bucket").collect()] == [None, None, 1.0, 2.0]


def test_growth_table_needs_first_year_and_counts_change_from_nothing_as_zero(make):
    rows = [("s", 2019, 1, 1, 2e6), ("s", 2020, 1, 1, 0.0), ("s", 2021, 2, 2, 4e6), ("late", 2021, 1, 1, 1e6)]
    df = make(rows, "primary_tag string, year int, deals long, priced long, amount double")
    r = D.sector_growth_table(df, 2019, 2021).collect()
    assert [x.primary_tag for x in r] == ["s"]
    assert (r[0].growth_2020, r[0].growth_2021, r[0].total_growth, r[0].best_year, r[0].worst_year) == (-100.0, 0.0, 100.0, 2021, 2020)


def test_investors_from_arrays_keep_their_own_round(make):
    df = make([(1, ["x", "y"], "Seed"), (2, ["x"], "Series A")], "id long, investors array<string>, round_type string")
    pairs = investing.explode_investors(df)
    assert {(r.investor, r.round_type) for r in pairs.collect()} == {("x", "Seed"), ("y", "Seed"), ("x", "Series A")}


def test_rounded_shares_total_one_hundred(make):
    df = make([(i, "USA", k) for i, k in enumerate(["a", "a", "b", "b", "c", "c", "d"])], "deal_id long, investor_country string, round_type string")
    assert sum(r.share for r in investing.region_round_share(df).collect()) == pytest.approx(100.0)


def test_unknown_country_is_other(make):
    df = make([("Canada",), (None,), ("France",)], "investor_country string")
    assert [r.region for r in projections.home_region(df).collect()] == ["Canada", V.REGION_OTHER, V.REGION_OTHER]


def test_stage_names():
    assert len(V.STAGES) == 9 and V.STAGES_GROWTH["Private Equity"] == "Growth" and V.STAGES_AGE["Series G"] == "Late Stage"


def test_stage_of_unmapped_round_is_null(make):
    assert [r.stage for r in projections.stage(make([("Grant",), ("Seed",), (None,)], "round_type string")).collect()] == [None, "Seed", None]


def test_clean_pipeline_drops_user_and_unusual_durations(make):
    rows = [(1, f"s{i}", 0, "x") for i in range(30)] + [(1, "long", 0, "x"), (1, "long", 900, "y")]
    df = events(make, rows).withColumns({
        "device_family": F.lit("Linux"), "region": F.lit(None).cast("string"), "city": F.lit(None).cast("string"),
        "client_upload_time": F.col("event_time"), "server_upload_time": F.col("event_time"), "processed_time": F.col("event_time"),
    })
    done = cleaning.clean(df, cutoff="2024-01-01", constants=())
    assert "user_id" not in done.columns and done.where("session_id = 'long'").count() == 0
    assert {r.region for r in done.collect()} == {"Unknown"}

"""Frequent values against counts of all values."""

from collections import Counter

import pytest

from dealflux.operators import profile as P


def frequent(values, share):
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    return {v: n for v, n in counts.items() if n / total > share}


@pytest.mark.parametrize("share", [0.3, 0.05, 0.011])
def test_every_value_above_the_share_with_its_count(spark, share):
    # One value holds a third; a tail of 6,000 values far exceeds the counters; one value is exactly at 5 %.
    values = ["hot"] * 4000 + ["even"] * 600 + ["warm"] * 140 + [None] * 500 + [f"v{i}" for i in range(6000)] + [f"w{i % 630}" for i in range(1260)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "kind string, value long").repartition(7, "value")
    got = P.frequent_values(df, "kind", share=share).collect()
    assert {r.value: r.n for r in got} == frequent(values, share)


def test_numbers_empty_tables_and_limits(spark):
    df = spark.createDataFrame([(7,), (7,), (8,), (None,)], "a long")
    assert {(r.value, r.n, r.share) for r in P.frequent_values(df, "a", share=0.5).collect()} == {(7, 2, 2 / 3)}
    assert P.frequent_values(df.where("a > 9"), "a").count() == 0
    assert P.frequent_values(df.where("a IS NULL"), "a").count() == 0
    with pytest.raises(ValueError):
        P.frequent_values(df, "a", share=1e-6)

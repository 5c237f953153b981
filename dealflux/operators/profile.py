"""Column profiles: nulls, distinct values, frequencies, spread, outliers, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.plans import kernels as K

TEXT_TYPES = ("string",)
#: Most counters of a frequent-items sketch, Spark's limit.
MOST_COUNTERS = 1 << 19
NUMBER_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def columns_of(df: DataFrame, kinds: Sequence[str]) -> list[str]:
    return [n for n, k in df.dtypes if k in kinds]


def as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])


def as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])


def value_counts(df: DataFrame, column: str, *, top: int | None = None, keep_null: bool = False) -> DataFrame:
    """Frequency and percent of each value."""
    rows = df if keep_null else K.present(df, column)
    counts = K.share_of(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "n", (), "percent")
    return counts if top is None else K.top_k(counts, top, F.desc("n"), F.asc(column))


def value_counts_other(df: DataFrame, column: str, *, below: float = 1.0, other: str = "Other") -> DataFrame:
    """Share per value, with values below a percent folded into one row."""
    shares = value_counts(df, column)
    label = F.when(F.col("percent") < below, F.lit(other)).otherwise(F.col(column))
    return shares.groupBy(label.alias(column)).agg(F.sum("n").alias("n"), F.sum("percent").alias("percent"))


def append_other_row(shares: DataFrame, column: str, *, top: int, other: str = "Other") -> DataFrame:
    """The top rows of a share table followed by one row holding the rest."""
    kept = K.top_k(shares, top, F.desc("n"), F.asc(column))
    rest = shares.join(kept.select(column), column, "left_anti").agg(
        F.lit(other).alias(column), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("percent"), F.lit(0.0)).alias("percent")
    )
    return kept.unionByName(rest)


def sampled_counts(df: DataFrame, column: str, key: str, *, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Value counts of a sample by key hash, scaled up to the whole table."""
    picked = df.where(K.hash_share(F.col(key), seed) < fraction)
    counts = K.aggregate_by(picked, [column], sample_n=F.count(F.lit(1)))
    return counts.withColumn("estimated_n", F.round(F.col("sample_n") / fraction).cast("bigint"))


def frequent_values(df: DataFrame, column: str, *, share: float = 0.01) -> DataFrame:
    """Values that more than ``share`` of the rows with one hold: value, n (exact), share of those rows.

    A mergeable frequent-items sketch of 14 / share counters or more errs by a quarter of ``share`` at most, so it
    names every such value among its 2 / share largest. A second pass counts these candidates only, so columns of
    very many values are never grouped by and a hot value is summed in tasks. Nulls are no value.
    """
    counters = 1 << (math.ceil(14 / share) - 1).bit_length()
    if counters > MOST_COUNTERS:
        raise ValueError(f"share {share} asks for {counters} counters, at most {MOST_COUNTERS} are kept")
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    sketch = F.call_function("approx_top_k", F.col("value"), F.lit(math.ceil(2 / share)), F.lit(counters))
    named = rows.agg(sketch.alias("_top")).select(F.explode("_top").alias("_item")).select("_item.item")
    named = named.select(F.col("item").alias("value"))
    counts = rows.join(F.broadcast(named), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("share", C.ratio(F.col("n"), K.scalar(rows, F.count(F.lit(1)))))
    return counts.where(F.col("share") > share)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, non-null, null and null percent, from one aggregation."""
    cols = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in cols])
    long = K.unpivot(counts, ["_rows"], cols, "column_name", "non_null")
    return long.select(
        "column_name", F.col("_rows").alias("rows"), "non_null",
        (F.col("_rows") - F.col("non_null")).alias("nulls"),
        C.percent(F.col("_rows") - F.col("non_null"), "_rows").alias("null_percent"),
    )


def unique_profile(df: DataFrame, columns: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """Per column: distinct values, uniqueness percent and class.

    Exact counts go through (column, value) pairs, so the work is spread by value; ``approx``
    uses one sketch per column and no shuffle of values at all.
    """
    cols = list(columns or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in cols])
        found = K.unpivot(wide, [], cols, "column_name", "distinct_values")
    else:
        long = K.unpivot(as_text(df, cols), [], cols, "column_name", "_v")
        found = (
            long.where(F.col("_v").isNotNull()).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
        )
        names = df.agg(F.count(F.lit(1))).select(F.explode(K.literal_array(cols)).alias("column_name"))
        found = names.join(found, "column_name", "left").fillna({"distinct_values": 0})
    rows = K.scalar(df, F.count(F.lit(1)))
    share = C.percent("distinct_values", rows)
    kind = (
        F.when(F.col("distinct_values") == 1, "constant")
        .when(share > 90, "high")
        .when(F.col("distinct_values").between(2, 5), "low")
        .otherwise("medium")
    )
    return found.select("column_name", "distinct_values", share.alias("unique_percent"), kind.alias("uniqueness"))


def categorical_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all listed columns, from one scan."""
    long = K.unpivot(as_text(df, columns), [], list(columns), "column_name", "value")
    return K.aggregate_by(long, ["column_name", "value"], n=F.count(F.lit(1)))


def categorical_profile(df: DataFrame, columns: Sequence[str], *, top: int = 10) -> DataFrame:
    """Distinct count and most frequent values per categorical column."""
    counts = categorical_counts(df, columns)
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    ranked = K.top_per_group(counts, ["column_name"], top, F.desc("n"), F.asc("value"))
    return ranked.join(sizes, "column_name")


def imbalance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest to smallest frequency, and the share of the dominant value, per column."""
    return categorical_counts(df, columns).groupBy("column_name").agg(
        C.ratio(F.max("n"), F.min("n")).alias("imbalance_ratio"), C.percent(F.max("n"), F.sum("n")).alias("dominant_percent")
    )


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """describe() of every numeric column."""
    cols = list(columns or columns_of(df, NUMBER_TYPES))
    return K.describe(K.unpivot(as_double(df, cols), [], cols, "column_name", "value"), ["column_name"], "value", bounded=True)


def iqr_outliers(df: DataFrame, columns: Sequence[str], *, factor: float = 1.5) -> DataFrame:
    """Rows outside Q1 - f IQR .. Q3 + f IQR per numeric column."""
    cols = list(columns)
    long = K.unpivot(as_double(df, cols), [], cols, "column_name", "value").where(F.col("value").isNotNull())
    q = K.exact_percentiles(long, ["column_name"], "value", {"q1": 0.25, "q3": 0.75}, bounded=True)
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - factor * iqr) | (F.col("value") > F.col("q3") + factor * iqr)
    # One row per listed column.
    return long.join(F.broadcast(q), "column_name").groupBy("column_name").agg(
        F.count_if(out).alias("outliers"), C.percent(F.count_if(out), F.count(F.lit(1))).alias("outlier_percent")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], *, above: float | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregation."""
    cols = list(columns)
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"_{i}").alias("correlation"))
             for i, (a, b) in enumerate(pairs)]
    long = row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return long if above is None else long.where(F.abs("correlation") > above)


def quality_checks(df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Duplicate rows, rows with any null, and zeros in the listed numeric columns."""
    cols = [f"`{c}`" for c in df.columns]
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    zero = F.lit(False)
    for c in numeric:
        zero = zero | (F.col(c) == 0)
    total = F.sum("_n")
    return groups.agg(
        F.coalesce(total, F.lit(0)).alias("rows"),
        F.coalesce(total - F.count(F.lit(1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum(F.when(zero, F.col("_n"))), F.lit(0)).alias("zero_rows"),
    )


def json_structure_profile(df: DataFrame, column: str, *, top: int = 5) -> DataFrame:
    """Key sets of a JSON text column with their frequency; totals on every row."""
    keys = F.array_join(F.array_sort(F.json_object_keys(column)), ",")
    known = K.present(df.select(F.col(column).alias("_j"), keys.alias("structure")), "_j")
    counts = known.groupBy("structure").agg(F.count(F.lit(1)).alias("n"))
    ranked = K.top_k(counts, top, F.desc("n"), F.asc("structure"))
    return ranked.withColumns(
        {
            "rows": K.scalar(df, F.count(F.lit(1))),
            "non_null": K.scalar(df, F.count(column)),
            "distinct_payloads": K.scalar(df, F.count_distinct(column)),
        }
    )

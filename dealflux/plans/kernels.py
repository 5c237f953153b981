"""Plan building blocks: totals, shares, grids, top-k, modes, growth and exact percentiles.

None of them opens an unpartitioned window over raw rows. One-row statistics enter a plan as
scalar subqueries, and tables are only joined on keys, so that Spark may choose a broadcast from
the size it measures and a shuffled join otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions.columns import ratio


def present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose grouping columns are all non-null."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def scalar(df: DataFrame, agg: Column) -> Column:
    """A one-row aggregate of ``df`` as a scalar subquery."""
    return df.select(agg.alias("_s")).scalar()


def aggregate_by(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """Group-by that drops null keys and names its measures."""
    return present(df, *keys).groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_keys(df: DataFrame, key: str, measure: Column, k: int, *, ascending: bool = False) -> DataFrame:
    """The k keys with the largest (smallest) measure; ties by key."""
    totals = aggregate_by(df, [key], _m=measure)
    first = F.asc("_m") if ascending else F.desc("_m")
    return top_k(totals, k, first, F.asc(key)).select(key)


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is listed (semi join)."""
    return df.join(keys, keys.columns, "left_semi")


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First k rows of each group; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def share_of(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Percent of the group (or grand) total, over an aggregated table."""
    if keys:
        whole = F.sum(value).over(Window.partitionBy(*keys))
    else:
        whole = scalar(df, F.sum(value))
    return df.withColumn(out, ratio(value, whole) * 100.0)


def mode_by(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    counts = present(df, *keys, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_neg"), F.col(value).alias("_v")))
    return counts.groupBy(*keys).agg(best.getField("_v").alias(out or value))


def values_array(df: DataFrame, column: str) -> Column:
    """Sorted distinct values of a dictionary-like column as a scalar array."""
    distinct = present(df.select(column), column).distinct()
    return scalar(distinct, F.sort_array(F.collect_set(column)))


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def grid_fill(df: DataFrame, rows: DataFrame, column: str, values: Column, fills: Mapping[str, object]) -> DataFrame:
    """Complete an aggregated table over (row keys x listed values), filling absent measures.

    ``values`` is an array column: a literal list, or ``values_array`` of a dictionary-like
    column. Each row key is expanded in place, so no cross join is planned.
    """
    keys = rows.columns
    grid = rows.distinct().withColumn(column, F.explode(values))
    return grid.join(df, [*keys, column], "left").fillna(dict(fills))


def calendar(df: DataFrame, ts: str, step: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every bucket from first to last per key (step: day, hour, month, ...)."""
    edges = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    span = F.sequence(F.col("_lo"), F.col("_hi"), F.expr(f"interval 1 {step}"))
    return edges.where(F.col("_lo").isNotNull()).select(*keys, F.explode(span).alias(ts))


def growth(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, n: int = 1) -> DataFrame:
    """Percent change against the n-th previous row of a per-key series of aggregates."""
    before = F.lag(value, n).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, ratio(F.col(value) - before, before) * 100.0)


def crosstab(df: DataFrame, row: str, column: str, values: Column, measure: Column | None = None, out: str = "n") -> DataFrame:
    """Long, zero-filled contingency table; a listed value no row holds still appears."""
    cells = aggregate_by(df, [row, column], **{out: measure if measure is not None else F.count(F.lit(1))})
    return grid_fill(cells, cells.select(row), column, values, {out: 0})


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 10_000,
    *,
    bounded: bool = False,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, without gathering a group in one task.

    A mergeable sketch brackets each wanted rank; a second pass counts what lies below the
    bracket and keeps only the distinct values inside it, so that the final ordered step sees a
    small, proven fraction of a large group (and a small group whole).

    ``bounded`` says that the schema or the calendar bounds the number of groups (column names,
    years). The brackets, a few numbers per group, are then broadcast and raw rows never shuffled;
    otherwise Spark picks the join by measured size.
    """
    keys = list(keys)
    rows = present(df.select(*keys, F.col(value).cast("double").alias("_v")), *keys, "_v")
    margin = 4.0 / accuracy
    cuts = [c for p in probs.values() for c in (max(0.0, p - margin), min(1.0, p + margin))]
    measures = [
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"),
    ]
    if keys:
        sketch = rows.groupBy(*keys).agg(*measures)
        marked = rows.join(F.broadcast(sketch) if bounded else sketch, keys)
    else:
        marked = rows.withColumn("_s", rows.agg(*measures).select(F.struct("*")).scalar()).select("_v", "_s.*")
    small = F.col("_n") <= accuracy
    wanted = []
    for i, (name, p) in enumerate(probs.items()):
        low = F.col("_min") if p <= margin else F.when(small, F.col("_min")).otherwise(F.col("_cuts")[2 * i])
        high = F.col("_max") if p >= 1 - margin else F.when(small, F.col("_max")).otherwise(F.col("_cuts")[2 * i + 1])
        kept = F.when(F.col("_v") < low, F.lit(float("-inf"))).otherwise(F.col("_v"))
        place = F.lit(p) * (F.col("_n") - 1)
        wanted.append(
            F.when(F.col("_v") <= high, F.struct(F.lit(name).alias("_p"), place.alias("_at"), kept.alias("_x")))
        )
    counted = (
        marked.select(*keys, F.explode(F.array_compact(F.array(*wanted))).alias("_w"))
        .groupBy(*keys, "_w._p", "_w._at", "_w._x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_x"))
    lower = F.floor("_at")
    covers = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    ends = (
        counted.withColumn("_upto", upto)
        .groupBy(*keys, "_p")
        .agg(
            F.max(F.when(covers(lower), F.col("_x"))).alias("_a"),
            F.max(F.when(covers(lower + 1), F.col("_x"))).alias("_b"),
            F.max(F.col("_at") - lower).alias("_f"),
        )
    )
    point = F.when(F.col("_f") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).otherwise(F.col("_a"))
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == name, point)).alias(name) for name in probs]
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, keys: Sequence[str], value: str, *, bounded: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max of one column per group (one row without keys)."""
    keys = list(keys)
    rows = present(df, *keys)
    basics = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ]
    points = exact_percentiles(rows, keys, value, QUARTILES, bounded=bounded)
    if keys:
        return rows.groupBy(*keys).agg(*basics).join(points, keys, "left")
    packed = points.select(F.struct(*QUARTILES)).scalar()
    return rows.agg(*basics).withColumn("_p", packed).select("*", "_p.*").drop("_p")


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form; values are cast to a common type by the caller."""
    cells = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns]
    return df.select(*ids, F.explode(F.array(*cells)).alias("_cell")).select(*ids, "_cell.*")


def range_rank(df: DataFrame, value: str, out: str = "id") -> DataFrame:
    """0-based rank of distinct values.

    Values are dealt into ranges of like size, whatever they begin with, and stored with their range's number;
    they are ranked inside their range, and the ranges' sizes give the offsets. The only single-task step
    runs over one row per range.
    """
    from dealflux.session import cut

    distinct = cut(present(df.select(value), value).distinct().repartitionByRange(value).withColumn("_b", F.spark_partition_id()))
    sizes = distinct.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    ordered = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_size").over(ordered), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(value)) - 1
    return (
        distinct.withColumn("_i", inside)
        .join(offsets, "_b")
        .select(value, (F.col("_i") + F.col("_offset")).cast("bigint").alias(out))
    )


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 that depends on the key alone: the beginning of an MD5, which other engines compute alike."""
    text = F.concat(F.lit(f"{seed}#"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)

"""Exact distinct counts as bitmaps that merge, so that one stored rollup serves every coarser grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.plans import kernels as K


def rollup(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, bucket, bits): the values of each column that stand with each key.

    Values get dense ids in order; a bucket holds 32,768 of them in 4 kB, so this pays where keys are few and
    hold many values each. Null values are in no set; a key without any has one row without bits.
    """
    parts = [df.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("column"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"))]
    for c in columns:
        ids = K.range_rank(df.select(F.col(c).alias("_value")), "_value", "_id").withColumn("_id", F.col("_id") + 1)
        pairs = df.select(*keys, F.col(c).alias("_value")).where("_value is not null").distinct().join(ids, "_value")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits")
        one = pairs.groupBy(*keys, F.bitmap_bucket_number("_id").alias("bucket")).agg(bits)
        parts.append(one.select(*keys, F.lit(c).alias("column"), "bucket", "bits"))
    return reduce(DataFrame.unionByName, parts)


def merged(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A rollup over fewer keys: bitmaps of one bucket are united."""
    return sets.groupBy(*keys, "column", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(sets: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Distinct values per key, a column of its own for each of ``names`` (column -> name); no value counts 0."""
    n = merged(sets, keys).withColumn("_n", F.when(F.col("column").isNotNull(), F.bitmap_count("bits")))
    return n.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("column") == c, F.col("_n"))), F.lit(0)).cast("long").alias(name) for c, name in names.items()])

"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a hash key; each source's documents stand in key order, cut into ranges of the key
space so that no range grows with its source. Prefix sums of sizes over the ranges place every document
on its source's line of words, and the source's budget cuts the line: whole rounds of the line first
(epochs), then its beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.llm.common import prefix_sums, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Documents in one range of the key space, about.
RANGE_ROWS = 2_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from one row (source, source_size, n) per source.

    All sizes are shared by weight; no target exceeds ``most`` times its source's size, and what is
    over goes to the other sources by weight. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    rows = sizes.withColumn("_w", w).withColumn("_cap", cap).withColumn("_r", F.col("_cap") / F.col("_w"))
    # Sources fill up in order of cap / weight; the level is what the unfilled ones share per weight.
    before = Window.orderBy("_r", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / open_w)
    level = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(every)
    return rows.withColumn("_final", level).select(
        "source",
        "source_size",
        "n",
        F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("_w"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target, taken.

    ``taken`` counts words, with repeats: ``epochs`` whole rounds of the document and ``part`` words of
    the round that the budget cuts. Null sources are one source, the last; a null or empty text has
    size 0 and is never taken; repeated rows stand beside each other and count like any others. Ties of
    the key fall to the smaller id and size. Columns of the input other than these three are ignored.
    """
    rows = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size.cast("long")).alias("size"))
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per, weights, most).withColumnRenamed("source", "_source")
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["_source"]), "left").drop("_source")
    first = F.conv(F.substring("_key", 1, 12), 16, 10).cast("long")
    ranges = F.ceil(F.col("n") / range_rows)
    rows = rows.withColumn("_range", F.floor(first * ranges / float(1 << 48)).cast("long"))
    rows = prefix_sums(rows, "source", "_range", ["_key", F.col("doc_id").asc_nulls_first(), "size"], "size", "_before")
    budget = F.floor(F.col("target") + 1e-6).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("_rounds") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("long")
    return (
        rows.withColumn("_rounds", rounds)
        .withColumn("part", part)
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("_rounds") * F.col("size") + F.col("part")).alias("taken"),
            F.when(F.col("size") > 0, F.col("_rounds")).otherwise(0).cast("long").alias("epochs"),
            "part", F.col("_key").alias("key"),
        )
    )


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS k
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
    FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS r FROM s),
l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM r WINDOW b AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= r) * w, cap))::DOUBLE AS target FROM l),
p AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS budget,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) + 0.0 AS target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""

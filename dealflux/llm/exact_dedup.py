"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

One scan takes each text's length and the hash of its first characters. Lengths that stand once leave,
then pairs of length and prefix hash that stand once; only texts of the pairs that are left are read
whole and hashed. Wanted pairs reach the second scan as a bitmap, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import staged
from dealflux.llm.group_joins import join_counted, mark_members

PREFIX_CHARS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty. ASCII texts take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _refined(marks: DataFrame) -> DataFrame:
    """(_len, _prefix) of texts that another text may equal."""
    lengths = staged(marks.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"), "lengths")
    alike = mark_members(marks, lengths, ["_len"], "_hit").where("_hit")
    return staged(alike.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_prefix"), "prefixes")


def groups(docs: DataFrame, text: str = "text", order: str = "doc_id", carry: dict[str, Column] | None = None, digests: bool = False) -> DataFrame:
    """Every row of ``docs``: its ``order`` value, the ``carry`` columns, keep_id, group_size, kept, digest.

    Rows are equal when their normalised texts are; of equal rows the one with the largest ``order``
    value stays and keep_id holds that value. ``digest`` is the SHA-256 of the normalised text in
    hexadecimal; without ``digests`` it is null where length and prefix rule an equal text out.

    Null and empty texts are equal. A null order value is below all others and keep_id is null where a
    group has no other. Of rows tied for the largest value, repeated rows say, exactly one stays; which
    one of them is not defined. An empty table gives no rows. Other columns of ``docs`` are ignored
    unless carried; carried names must differ from the result's own.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    keyed = {"_len": F.octet_length(value), "_prefix": F.xxhash64(normal(F.substring(value, 1, PREFIX_CHARS)))}
    wanted = _refined(staged(docs.select(*[c.alias(k) for k, c in keyed.items()]), "marks"))
    rows = docs.select(F.col(order).alias("_order"), value.alias("_text"), *[c.alias(k) for k, c in {**(carry or {}), **keyed}.items()])
    rows = mark_members(rows, wanted, ["_len", "_prefix"], "_hit")
    whole = F.sha2(normal(F.col("_text")).cast("binary"), 256)
    rows = rows.withColumn("digest", whole if digests else F.when(F.col("_hit"), whole)).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows.drop("_text", "_prefix"), "digests")
    same = (
        rows.where("_hit").groupBy("_len", "digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("_order", "_row")).alias("_last"))
        .where("group_size > 1")
    )
    same = staged(same, "equal")
    total = rows.count()
    found = join_counted(rows.where("_hit"), same, ["_len", "digest"], "group_size", total)
    alone = rows.where("not _hit").withColumn("group_size", F.lit(None).cast("long")).withColumn("_last", F.lit(None).cast(same.schema["_last"].dataType))
    return found.unionByName(alone).select(
        F.col("_order").alias(order), *(carry or {}),
        F.when(F.col("_last").isNull(), F.col("_order")).otherwise(F.col("_last._order")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_last").isNull() | (F.col("_last._row") == F.col("_row"))).alias("kept"),
        "digest",
    )


def deduplicated(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns and one row of each set of equal texts, chosen as in ``groups``."""
    held = {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = groups(docs, text, order, held).where("kept")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, text_sha256,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

"""Joins of rows with a row per key, for keys that may hold a large share of all rows or very many values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is heavy; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000
#: Largest bitmap that is broadcast, and bits in it for each key.
BITMAP_BYTES = 64 << 20
BITS_A_KEY = 16
#: Words of 64 bits in a row of the bitmap.
BUCKET = 64


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``groups``, a table with one row per key and its number of rows in ``count``.

    Heavy keys, fewer than 1,000 whatever the input, are broadcast, so their rows stay where they are;
    the others are dealt out by key, at most a thousandth of ``total`` rows each. Keys are not null.
    """
    heavy = groups.where(F.col(count) > F.lit(total * HEAVY))
    light = groups.where(F.col(count) <= F.lit(total * HEAVY))
    hot = rows.join(F.broadcast(heavy), keys)
    return hot.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how))


def mark_members(rows: DataFrame, wanted: DataFrame, keys: list[str], out: str, limit: int = BITMAP_BYTES) -> DataFrame:
    """``rows`` with ``out``: true where the keys stand in ``wanted``, which has each key once; no key is null.

    Up to ``limit`` bytes ``wanted`` travels as a bitmap over key hashes, so rows stay where they are and
    about one key in 16 that is not wanted is marked too. Beyond it both sides are dealt out by key.
    """
    bits = 1 << max(15, (BITS_A_KEY * wanted.count()).bit_length())
    if bits // 8 > limit:
        return rows.join(wanted.select(*keys, F.lit(True).alias(out)), keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, bit = F.shiftright("_place", 6) % BUCKET, (F.col("_place") % 64).cast("int")
    bucket = F.shiftright("_place", 6 + BUCKET.bit_length() - 1)
    words = (
        wanted.select(place.alias("_place"))
        .groupBy(bucket.alias("_bucket"), word.cast("int").alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    )
    maps = words.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BUCKET - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long")))
    placed = rows.withColumn("_place", place).withColumn("_bucket", bucket)
    found = placed.join(F.broadcast(maps.select("_bucket", every.alias("_map"))), "_bucket", "left")
    held = F.getbit(F.get("_map", word.cast("int")), bit) == 1
    return found.withColumn(out, F.coalesce(held, F.lit(False))).drop("_place", "_bucket", "_map")

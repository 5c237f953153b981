"""Neighbours in ordered groups that may be very large.

A window over ``partition by session`` puts a whole session into one task. Here every group is cut
into time chunks; a window runs inside (group, chunk), and the few rows needed from the following
chunks come from a small per-chunk table. Chunking depends on the time stamp alone, so a lost task
recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 3600


def chunk_of(ts: Column | str, seconds: float = CHUNK_SECONDS) -> Column:
    """Number of the time chunk a time stamp falls into."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1e6)).cast("bigint")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    *,
    n: int = 1,
    backwards: bool = False,
    chunk: Column | None = None,
    out: str = "_next",
) -> DataFrame:
    """Add ``out``: the up to ``n`` following (preceding) rows' payload as an array of structs.

    ``order`` starts with the time stamp and is total inside a group. For ``backwards`` the
    nearest preceding row comes first. Rows with a null key are dropped.
    """
    keys = list(keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    base = df.withColumn("_chunk", chunk if chunk is not None else chunk_of(order[0]))
    turn = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*[turn(c) for c in order])
    item = F.struct(*payload)
    base = base.withColumn("_rn", F.row_number().over(inside))
    across = Window.partitionBy(*keys).orderBy(turn("_chunk"))
    if n == 1:
        base = base.withColumn("_near", F.lead(item, 1).over(inside))
        heads = base.where(F.col("_rn") == 1).select(*keys, "_chunk", item.alias("_head"))
        carry = heads.select(*keys, "_chunk", F.lead("_head", 1).over(across).alias("_carry"))
        found = F.array_compact(F.array(F.coalesce("_near", "_carry")))
    else:
        near = [F.lead(item, i).over(inside) for i in range(1, n + 1)]
        base = base.withColumn("_near", F.array_compact(F.array(*near)))
        heads = (
            base.where(F.col("_rn") <= n)
            .groupBy(*keys, "_chunk")
            .agg(F.sort_array(F.collect_list(F.struct("_rn", item.alias("_item")))).alias("_heads"))
        )
        later = F.flatten(F.collect_list(F.col("_heads._item")).over(across.rowsBetween(1, n)))
        carry = heads.select(*keys, "_chunk", F.slice(later, 1, n).alias("_carry"))
        none = F.array().cast(carry.schema["_carry"].dataType)
        found = F.slice(F.concat("_near", F.coalesce("_carry", none)), 1, n)
    joined = base.join(carry, [*keys, "_chunk"], "left")
    return joined.withColumn(out, found).drop("_chunk", "_rn", "_near", "_carry")


def earlier_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: Column | None = None, out: str = "earlier") -> DataFrame:
    """Add ``out``: how many rows of its group stand before each row; rows equal in ``order`` have the same number.

    ``order`` starts with the time stamp, null first. Rows with a null key are dropped.
    """
    keys = list(keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    base = df.withColumn("_chunk", chunk if chunk is not None else chunk_of(order[0]))
    inside = F.rank().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    chunks = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = base.groupBy(*keys, F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_c", F.coalesce(F.sum("_n").over(chunks), F.lit(0)).alias("_before"))
    same = F.col("_chunk").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    joined = base.withColumn("_inside", inside).join(sizes, same)
    return joined.withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint")).select(*df.columns, out)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], **kw) -> DataFrame:
    """The next row's payload as columns prefixed ``next_`` (null at the end of the group)."""
    wide = neighbours(df, keys, order, payload, n=1, out="_next", **kw)
    added = [F.get("_next", 0).getField(c).alias(f"next_{c}") for c in payload]
    return wide.select("*", *added).drop("_next")


def preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], **kw) -> DataFrame:
    """The previous row's payload as columns prefixed ``prev_``."""
    wide = neighbours(df, keys, order, payload, n=1, backwards=True, out="_prev", **kw)
    added = [F.get("_prev", 0).getField(c).alias(f"prev_{c}") for c in payload]
    return wide.select("*", *added).drop("_prev")


def sessionize(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    *,
    gap_seconds: int = 12 * 3600,
    out: str = "session_no",
) -> DataFrame:
    """Number each user's sessions, a new one starting after more than ``gap_seconds`` of silence.

    Time is cut into chunks no wider than the gap, so that a chunk never holds a session break.
    The running count of breaks then needs only each chunk's first and last time, and is joined
    back; raw rows are never sorted by user.
    """
    chunked = df.where(F.col(user).isNotNull()).withColumn("_chunk", chunk_of(ts, gap_seconds))
    spans = chunked.groupBy(user, "_chunk").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    by_user = Window.partitionBy(user).orderBy("_chunk")
    silent = F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(
        F.lag("_last").over(by_user).cast("timestamp")
    )
    breaks = spans.withColumn("_new", F.when(silent > gap_seconds * 1_000_000, 1).otherwise(0))
    numbered = breaks.select(user, "_chunk", F.sum("_new").over(by_user).cast("bigint").alias(out))
    return chunked.join(numbered, [user, "_chunk"]).drop("_chunk")

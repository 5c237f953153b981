"""Best-fit packing under conflicts.

Documents longer than a bin are cut into full bins and a rest. The pieces of a shard go, longest first,
each into the open bin with the least sufficient room that holds no piece of the same duplicate cluster
and fewer than a fixed number of pieces of its source: bins stand in order of their room, and the search
walks on to the next larger room until a compatible one is found. A bin carries its clusters and, for each
count up to the limit, its sources as bitmaps.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Pieces of one source that a bin may hold; of one cluster it holds one.
SOURCE_LIMIT = 4
#: Units packed together in one task, about, in bins.
SHARD_BINS = 1024


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, source_limit: int) -> list[int]:
    """Bin number of each piece (length, cluster, source), given in order of falling length.

    Equal pieces stand together, and the next of them resumes the search where the last one ended: all
    bins before are still in conflict with it.
    """
    rooms: list[tuple[int, int]] = []
    clusters: list[int] = []
    sources: list[list[int]] = []
    out: list[int] = []
    last, resume = None, (0, -1)
    for piece in pieces:
        length, cluster, source = piece
        at = bisect_left(rooms, resume if piece == last else (length, -1))
        c, s = 1 << cluster, 1 << source
        while at < len(rooms):
            b = rooms[at][1]
            if not clusters[b] & c and not sources[b][-1] & s:
                break
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
            resume = (room, b)
        else:
            room, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * source_limit)
            resume = (capacity + 1, -1)
        clusters[b] |= c
        for k, bits in enumerate(sources[b]):
            if not bits & s:
                sources[b][k] = bits | s
                break
        if room > length:
            insort(rooms, (room - length, b))
        out.append(b)
        last = piece
    return out


def _pack_shard(capacity: int, source_limit: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_cluster", "_source", "_row", "piece"], ascending=[False, True, True, True, True])
        # Large clusters take the least numbers: a bitmap is as long as the greatest one in it.
        c = rows["_cluster"].map({v: i for i, v in enumerate(rows["_cluster"].value_counts().index)})
        # A null source takes a number of its own, like any other.
        s = pd.factorize(rows["_source"], use_na_sentinel=False)[0]
        bins = best_fit(list(zip(rows["length"].tolist(), c.tolist(), s.tolist())), capacity, source_limit)
        rows = rows.assign(shard=key[0], bin=bins)
        rows["at"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "start", "length", "shard", "bin", "at"]]

    return pack


def pack(
    docs: DataFrame,
    length: Column,
    cluster: Column,
    capacity: int = CAPACITY,
    source_limit: int = SOURCE_LIMIT,
    shard_bins: int = SHARD_BINS,
) -> DataFrame:
    """Pieces of all documents with their bins: doc_id, piece, start, length, shard, bin, at.

    ``length`` is the number of units of a document and ``cluster`` its duplicate cluster (null: its
    own, with rows like it); ``start`` is a piece's first unit in its document, ``at`` its place in the bin
    (shard, bin). A document without units (empty or null text) has one piece of length 0, which shares
    no bin with its cluster either. Repeated rows are packed each. Pieces go to shards of a bounded number
    of units by a hash of id and piece, so that one cluster or source with very many rows is spread over
    all shards; only lengths and hashes are shuffled.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(length, F.lit(0)).cast("long").alias("_n"), cluster.cast("string").alias("_c"))
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.col("_n"), F.lit(1))), F.lit(0))).first()[0]
    shards = max(1, -(-total // (capacity * shard_bins)))
    count = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    pieces = (
        rows.withColumn("_row", F.xxhash64("doc_id", "_n", "source", "_c"))
        .withColumn("_cluster", F.coalesce("_c", F.concat(F.lit("\0"), F.col("_row").cast("string"))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("start", (F.col("piece") * F.lit(capacity)).cast("long"))
        .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("start")))
        .withColumn("_shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))
        .select("doc_id", "piece", "start", "length", "_row", "_shard", F.xxhash64("_cluster").alias("_cluster"), F.xxhash64("source").alias("_source"))
    )
    schema = "doc_id long, piece int, start long, length long, shard long, bin long, at long"
    return pieces.groupBy("_shard").applyInPandas(_pack_shard(capacity, source_limit), schema)

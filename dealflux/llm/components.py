"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import staged

#: Most edges that one task may end in place of rounds: 32 MB of node numbers.
ONE_TASK = 1 << 21


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v) and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    u, v = at[: len(u)], at[len(u) :]
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        node, label = least_reached(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def components(edges: DataFrame, a: str, b: str, one_task: int = 0) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node it reaches.

    Up to ``one_task`` different edges are ended in one task, which spares the rounds.

    Edges stay a distributed table; a round is two aggregates and two joins on the node, so a hub
    with very many edges is split like any skewed join key. Rounds grow with the logarithm of the
    longest chain. Self-loops and repeated edges change nothing; null ends are ignored.
    """
    e = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = staged(e, "edges")
    if one_task and e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_ended, "node long, label long")
    seen = _state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        e = staged(small, "edges")
        state = _state(e)
        if state == seen:
            break
        seen = state
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("label"))
    )

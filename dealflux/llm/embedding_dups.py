"""Near-duplicate vectors of one label by rotated binary codes with correction factors.

A unit vector, turned by one random rotation, is stored as its signs; the factor <signs / sqrt(D), vector>
makes the signs' inner product with any other vector an unbiased estimate of the true one, and gives the
width of its error. Only pairs whose estimate plus error reaches the threshold are computed again, in
double precision. Equal vectors are one point with a count. The points of a label are cut into blocks, and
pairs of blocks meet in a task, which returns sums of links and a spanning forest instead of pairs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import staged
from dealflux.llm.components import components

THRESHOLD = 0.93
#: Width of the error interval in standard deviations of the estimate, as in e / sqrt(D - 1).
EPSILON = 4.0
#: Points of a block; estimates held at a time.
BLOCK_POINTS, TILE = 2048, 512
SEED = 20_24


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, their correction factors, error widths, and the rotated vectors."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim).T
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    error = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, dim - 1))
    return np.packbits(signs, axis=1), factor, error, turned


def estimates(packed: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated inner products of coded points with rotated vectors."""
    dim = turned.shape[1]
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (signs @ turned.astype(np.float32).T) / (np.sqrt(dim) * factor[:, None]).astype(np.float32)


def linked_pairs(a: np.ndarray, b: np.ndarray | None, coded: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float = THRESHOLD):
    """Index pairs of rows of ``a`` and ``b`` (or of ``a`` with itself, each once) with cosine >= threshold.

    ``coded`` are the stored codes, correction factors and error widths of ``a``.
    """
    ua = a / np.linalg.norm(a, axis=1, keepdims=True)
    ub = ua if b is None else b / np.linalg.norm(b, axis=1, keepdims=True)
    packed, factor, error = coded
    turned = ub @ rotation(ub.shape[1]).T
    for i in range(0, len(a), TILE):
        for j in range(0 if b is not None else i, len(ub), TILE):
            likely = estimates(packed[i : i + TILE], factor[i : i + TILE], turned[j : j + TILE]) + error[i : i + TILE, None] >= threshold
            x, y = np.nonzero(likely)
            x, y = x + i, y + j
            if b is None:
                x, y = x[x < y], y[x < y]
            exact = np.concatenate([np.einsum("ij,ij->i", ua[x[k : k + 65536]], ub[y[k : k + 65536]]) for k in range(0, len(x), 65536)] or [np.zeros(0)])
            ok = exact >= threshold
            yield x[ok], y[ok]


def _cell():
    def run(key, rows):
        own = rows.column("mine").to_numpy()
        first, second = key[2].as_py(), key[3].as_py()
        vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(own), -1)
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        left = np.flatnonzero(own == first)
        right = left if first == second else np.flatnonzero(own == second)
        count = np.zeros(len(own), np.int64)
        parent = list(range(len(own)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        edges = []
        found = ()
        if len(left) and len(right):
            mine = rows.take(pa.array(left))
            packed = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(left), -1)
            coded = packed, mine.column("factor").to_numpy(), mine.column("error").to_numpy()
            found = linked_pairs(vec[left], None if first == second else vec[right], coded)
        for x, y in found:
            x, y = left[x], right[y]
            np.add.at(count, x, copies[y])
            np.add.at(count, y, copies[x])
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = root(i), root(j)
                if p != q:
                    parent[q] = p
                    edges.append((i, j))
        some = np.flatnonzero(count)
        a = np.array([e[0] for e in edges], int)
        b = np.array([e[1] for e in edges], int)
        return pa.table(
            [
                pa.array(np.r_[node[some], node[a]]),
                pa.array(np.r_[count[some], np.zeros(len(a), np.int64)]),
                pa.array([None] * len(some) + node[b].tolist(), pa.int64()),
            ],
            names=["node", "links", "other"],
        )

    return run


def _points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, node, vec of comparable rows; node and vec null for the others."""

    def run(batches):
        for batch in batches:
            node, vec, dim = [], [], []
            for e, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                v = None
                if label is not None and e and None not in e:
                    v = np.array(e, np.float64) + 0.0  # a negative zero equals a zero
                    norm = np.linalg.norm(v)
                    v = v if np.isfinite(norm) and norm > 0 else None
                dim.append(0 if v is None else len(v))
                vec.append(None if v is None else v.tobytes())
                node.append(None if v is None else int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8, key=hashlib.blake2b(str(label).encode("utf-8", "surrogatepass")).digest()).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array(node, pa.int64()), pa.array(vec, pa.binary())], names=["vec_id", "label", "dim", "node", "vec"])

    return vectors.mapInArrow(run, "vec_id long, label string, dim int, node long, vec binary")


def coded(points: DataFrame) -> DataFrame:
    """``points`` (label, dim, node, vec, copies) with their codes, correction factors and error widths."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            code, factor, error = [None] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vec = np.frombuffer(b"".join(batch.column("vec").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), dim)
                packed, factor[at], error[at], _ = codes(vec / np.linalg.norm(vec, axis=1, keepdims=True))
                for i, c in zip(at.tolist(), packed):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor), pa.array(error)], names=[*batch.schema.names, "code", "factor", "error"])

    return points.mapInArrow(run, "label string, dim int, node long, vec binary, copies long, code binary, factor double, error double")


def near_duplicates(vectors: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of one label and length link at a cosine of 0.93 or more. Null labels, null, empty or zero vectors
    and vectors with null or non-finite components link with nothing. Rows of equal vectors link with each
    other, rows repeated wholly or with one id included. component_id is the least id reached; a null id is
    never one, and its row is not kept. Other columns are ignored.
    """
    rows = staged(_points(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))), "vectors")
    points = rows.where("node is not null").groupBy("label", "dim", "node").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"))
    points = staged(coded(points), "points")
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / block_points).cast("int").alias("blocks"))
    placed = points.join(sizes, ["label", "dim"]).withColumn("mine", F.pmod("node", F.col("blocks")).cast("int"))
    # A block meets every block of its label, itself included, in one cell each.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other"))
    # Codes travel with the side that is estimated; vectors with both, since survivors are computed where they meet.
    stored = [F.when(F.col("mine") == F.col("first"), F.col(c)).alias(c) for c in ("code", "factor", "error")]
    cells = placed.select("label", "dim", "first", "second", "mine", "node", "copies", "vec", *stored).groupBy("label", "dim", "first", "second")
    found = staged(cells.applyInArrow(_cell(), "node long, links long, other long"), "links")
    label = components(found.where("other is not null").select("node", "other"), "node", "other").withColumnRenamed("label", "_component")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = points.select("node", "copies").join(links, "node", "left").join(label, "node", "left")
    nodes = nodes.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("_component", "node").alias("_component"))
    out = rows.select("vec_id", "node").join(nodes, "node", "left")
    least = out.where("node is not null").groupBy("_component").agg(F.min("vec_id").alias("_least"))
    return out.join(least, "_component", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_least", "vec_id"), F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

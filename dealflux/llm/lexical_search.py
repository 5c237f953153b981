"""Ranked lexical search: documents grouped by which of a query's terms they hold.

Every text is cut into terms once; what a set of queries needs of it, its length and the counts of
the queries' terms, is written as a narrow table, from which all corpus statistics are sums. Queries
then read that table in blocks of documents. In a block a term is a bitmap over documents; stacking
and transposing the bitmaps of a query's terms gives each document its presence mask, and documents
are grouped by mask. A mask's score is at most the sum of its terms' greatest impacts in the block;
masks are evaluated by descending bound until the bound falls below the tenth score found so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dealflux.llm.common import staged

#: Queries that are searched together hold about so many term occurrences; more are searched in turn.
BLOCK_TERMS = 100_000
#: Documents of a block times terms of its queries.
BLOCK_CELLS = 8_000_000
BLOCK_DOCS = 4096
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: Lists of best documents per query are merged in so many groups first.
MERGES = 64

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, slice by slice: maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased."""
    if text:
        data = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
        start = 0
        while start < len(data):
            end = data.find(b" ", start + SLICE)
            end = len(data) if end < 0 else end
            yield data[start:end].split()
            start = end


def _counted(text: str | None) -> Counter:
    held: Counter = Counter()
    for part in terms(text):
        held.update(part)
    return held


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What an occurrence count is worth in a document of so many terms, before the term's weight."""
    m = 100 - 90 + (90 * n_terms.astype(np.int64) * n_docs) // n_all
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def _postings(docs: DataFrame, text: str, doc: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, ids, tfs) of every text with a term: its length in terms and its counts of the vocabulary."""
    kind = docs.schema[doc].dataType

    def cut(batches):
        for batch in batches:
            rows, n, ids, tfs = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                held = _counted(value.as_py())
                if held:
                    known = sorted((vocabulary[t], held[t]) for t in held.keys() & vocabulary.keys())
                    rows.append(i)
                    n.append(held.total())
                    ids.append([k for k, _ in known])
                    tfs.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc", "n", "ids", "tfs"],
            )

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(cut, f"doc {kind.simpleString()}, n long, ids array<int>, tfs array<long>")


class Block:
    """Some documents: a bitmap and an impact row for each vocabulary term, and the terms' greatest impacts."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, ids: np.ndarray, tfs: np.ndarray, size: int, n_docs: int, n_all: int):
        self.docs = len(n)
        at = np.repeat(np.arange(self.docs), lengths)
        self.impact = np.zeros((size, self.docs), np.int32)
        self.impact[ids, at] = impacts(tfs, n[at], n_docs, n_all)
        self.present = np.packbits(self.impact > 0, axis=1, bitorder="little")
        self.most = self.impact.max(axis=1, initial=0).astype(np.int64)

    def masks(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct presence masks of a query's terms, as rows of bits; documents in mask order; ends of each mask's documents."""
        bits = np.unpackbits(self.present[query], axis=1, count=self.docs, bitorder="little")
        wide = -(-len(query) // 64) * 8
        packed = np.zeros((self.docs, wide), np.uint8)
        got = np.packbits(bits, axis=0, bitorder="little")
        packed[:, : len(got)] = got.T
        words = packed.view(np.uint64)
        order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        words = words[order]
        ends = np.append(np.flatnonzero((words[1:] != words[:-1]).any(axis=1)) + 1, self.docs)
        held = np.unpackbits(words[ends - 1].view(np.uint8), axis=1, count=len(query), bitorder="little")
        return held, order, ends

    def best(self, query: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, row) of every document that may be among the k best scores at or above ``floor``."""
        held, order, ends = self.masks(query)
        bound = held.astype(np.int64) @ (weights * self.most[query])
        starts = np.append(0, ends[:-1])
        by_bound = np.argsort(-bound, kind="stable")
        found: list[tuple[int, int]] = []
        step, at = 1, 0
        while at < len(by_bound) and bound[by_bound[at]] >= max(floor, 1):
            some = by_bound[at : at + step]
            some = some[bound[some] >= max(floor, 1)]
            rows = np.concatenate([order[starts[g] : ends[g]] for g in some])
            scores = weights @ self.impact[np.ix_(query, rows)].astype(np.int64)
            good = scores >= max(floor, 1)
            found += zip(scores[good].tolist(), rows[good].tolist(), strict=True)
            if len(found) >= k:
                cut = sorted((s for s, _ in found), reverse=True)[k - 1]
                floor = max(floor, cut)
                found = [x for x in found if x[0] >= floor]
            at, step = at + step, step * 2
        return found


def _after(value) -> tuple:
    """Sort key of a document id: ascending, null last."""
    return (value is None, 0 if value is None else value)


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], size: int, n_docs: int, n_all: int, k: int, kind: pa.DataType):
    """Function over batches of postings that yields each query's best documents of a partition."""
    per_block = max(64, min(BLOCK_DOCS, BLOCK_CELLS // max(size, 1)))

    def run(batches):
        best: dict[int, list[tuple]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, per_block):
                part = whole.slice(start, per_block)
                doc, (n, ids, tfs) = part.column(0).to_pylist(), (part.column(i) for i in (1, 2, 3))
                block = Block(n.to_numpy(), ids.value_lengths().to_numpy(), ids.flatten().to_numpy(), tfs.flatten().to_numpy(), size, n_docs, n_all)
                for number, query, weights in queries:
                    own = best.get(number, [])
                    found = block.best(query, weights, k, own[-1][0] if len(own) == k else 1)
                    if found:
                        best[number] = sorted(own + [(s, doc[i]) for s, i in found], key=lambda x: (-x[0], _after(x[1])))[:k]
        rows = [(number, d, s) for number, own in best.items() for s, d in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
            names=["query", "doc", "score"],
        )

    return run


def _parts(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple]]:
    """Queries in parts of about ``most`` bytes of text each; rows that share an id are one query."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    for p in range(parts):
        held: dict = {}
        for r in rows.where(F.col("_part") == p).toLocalIterator():
            held.setdefault(r["item"], set()).update(t for part in terms(r["text"]) for t in part)
        yield sorted(((i, sorted(t)) for i, t in held.items() if t), key=lambda x: _after(x[0]))


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score) of the ``k`` best documents of each query, equal scores by ascending document id.

    Scores are whole numbers: a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), an occurrence count tf
    in a document of n terms is worth (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L; a
    document's score sums weight times worth over the query's distinct terms. Documents without a
    positive score are left out. N counts documents with a term, L all their terms.

    Every row of ``docs`` is a document of its own: repeated rows and rows that share an id are ranked
    each. Null and empty texts, and texts without a term, count nowhere. Null document ids come last
    among equal scores. Rows of ``items`` that share an id, null included, are one query with all their
    terms; a query without terms or without a match has no rows. Empty tables give no rows. Other
    columns are ignored. Queries are taken to the driver in parts of about ``BLOCK_TERMS`` * 8 bytes of
    text, and each part reads all documents.
    """
    spark, kinds = docs.sparkSession, (docs.schema[doc].dataType, items.schema[item].dataType)
    out = None
    for queries in _parts(items, item, item_text, BLOCK_TERMS * 8):
        if queries:
            found = _one_part(docs, queries, k, text, doc, kinds)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {kinds[1].simpleString()}, rank int, doc {kinds[0].simpleString()}, score long")
    return out.select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")


def _one_part(docs: DataFrame, queries: list[tuple], k: int, text: str, doc: str, kinds: tuple) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in queries for t in ts}))}
    postings = staged(_postings(docs, text, doc, vocabulary), "postings")
    n_docs, n_all = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(postings.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
    prepared = []
    for number, (_, ts) in enumerate(queries):
        known = np.array([vocabulary[t] for t in ts if vocabulary[t] in df], np.int64)
        weights = np.array([weight(n_docs, df[i]) for i in known.tolist()], np.int64)
        if (weights > 0).any():
            prepared.append((number, known[weights > 0], weights[weights > 0]))
    names = spark.createDataFrame([(number, i) for number, (i, _) in enumerate(queries)], f"query long, item {kinds[1].simpleString()}")
    run = _search(prepared, len(vocabulary), n_docs, n_all, k, to_arrow_type(kinds[0]))
    best = postings.mapInArrow(run, f"query long, doc {kinds[0].simpleString()}, score long")
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    merge = Window.partitionBy("query", "_merge").orderBy(*order)
    best = best.withColumn("_merge", F.spark_partition_id() % MERGES).withColumn("_rank", F.row_number().over(merge)).where(F.col("_rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "query").select("item", "rank", "doc", "score")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH lowered AS (
    SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
held AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM lowered),
counts AS (SELECT r, doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
frequent AS (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
    FROM benchmark),
weighed AS (
    SELECT item_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM wanted JOIN frequent USING (term), total),
scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
    FROM weighed JOIN counts USING (term) JOIN lengths USING (r), total GROUP BY ALL),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

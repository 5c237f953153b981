"""Corpus pipeline: quality, near copies, repeated passages, mixing, packing, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflux.llm import compression_quality, mixing, ngram_join, packing, repeats
from dealflux.llm.common import staged, table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of over 50 words are about 270 bytes and more; ``op7``'s 400 would leave most of those.
PASSAGE_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, accepts."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(compression_quality.score(F.col("text"), model) >= 0.5).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all without words."""
    return ngram_join.one_each(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES and more that stand elsewhere too."""
    return repeats.removed(docs, PASSAGE_BYTES).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a budget cuts stays if half of it or more fits."""
    times = F.col("epochs") + (2 * F.col("part") >= F.greatest("size", F.lit(1))).cast("int")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max(times).cast("int").alias("_times")).where("_times > 0")
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_id"]))
    return rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins; no bin holds a document twice."""
    return packing.pack(docs, word_count(F.col("text")), F.col("doc_id"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("passages", passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression sizes and byte-wise repeats are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written down before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

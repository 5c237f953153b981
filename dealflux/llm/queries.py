"""Queries of the operators over the supplied tables, and the SQL some of them must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflux.llm import backoff_lm, compression_quality, embedding_dups, exact_dedup, html_text, lexical_search, mixing, ngram_join, packing, prefix_trie, repeats, sketches, token_store
from dealflux.llm.common import staged, table, word_count
from dealflux.session import checkpoint_dir


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded, written in id order and read back: start, n_tokens, ids_crc32."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = f"{checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    token_store.write(docs, path, token_store.tokenizer_path())
    return token_store.positions(token_store.checksums(token_store.read(spark, path)))


def op2_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every text under a model of nine folds of ten."""
    docs = table(spark, folder, "documents")
    held = F.coalesce(compression_quality.fold(F.col("doc_id"), 10) == 0, F.lit(False))
    scored = backoff_lm.score(docs, ~held)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def near_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, cluster of every row of ``docs``: the component of near copies, for texts without shingles equal texts."""
    found = staged(ngram_join.join(docs).where("component is not null").select("doc_id", "text_hash", "component").distinct(), "clusters")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("_hash"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_md5"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["_hash"] == found["text_hash"]), "left")
    return staged(both.select(rows["doc_id"], "source", "n_words", F.coalesce(F.concat(F.lit("near:"), F.col("component").cast("string")), "_md5").alias("cluster")), "clustered")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document in bins of 4,096 words; near copies are one cluster."""
    docs = near_clusters(table(spark, folder, "documents"))
    return packing.pack(docs, F.col("n_words"), F.col("cluster"))


def op4_scaled_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return sketches.edited_likeness(table(spark, folder, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are 80 % alike."""
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", (F.round("target", 3) + F.lit(0.0)).alias("target"), "taken")


def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document outside strings of 400 bytes that also start elsewhere."""
    cut = repeats.removed(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors of one label."""
    return embedding_dups.near_duplicates(table(spark, folder, "embeddings"))


def op9_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op10_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every text from labels of two folds of three."""
    docs = table(spark, folder, "documents")
    held = compression_quality.fold(F.col("doc_id"), 3) == 1
    learnt = table(spark, folder, "labels").where(~F.coalesce(held, F.lit(True)))
    model = compression_quality.fit(docs, learnt)
    scored = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), compression_quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of equal texts of every document, and which one stays."""
    rows = exact_dedup.groups(table(spark, folder, "documents"), digests=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_backoff_lm": op2_backoff_lm,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_scaled_sketches": op4_scaled_sketches,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_source_mixing": op6_source_mixing,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_main_text": op9_html_main_text,
    "op10_compression_quality": op10_compression_quality,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op6_source_mixing": mixing.ORACLE,
    "op8_embedding_near_dedup": embedding_dups.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_ranked_search": lexical_search.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

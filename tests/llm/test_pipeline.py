"""The pipeline's stages on a small corpus, each against what its own input asks for."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from llm_fixtures import DATA, no_docs, odd_docs  # noqa: F401

from dealflux.llm import queries
from dealflux.llm.common import staged


def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, staged(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == P.COLUMNS
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == docs.count() <= before.count()
        if name == "passages":
            assert docs.count() == before.count() and docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    per_bin = docs.groupBy("shard", "bin").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("doc_id").alias("d"))
    assert per_bin.where("n > 4096 or k <> d").count() == 0


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_docs, no_docs):
        docs = rows
        for name, stage in P.STAGES:
            docs = staged(stage(spark, docs, str(tmp_path)), name)
            docs.count()


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passage, own = prose(52), [prose(120) for _ in range(3)]
    assert 250 < len(passage) < 400
    rows = [(0, f"{own[0]}\n{passage}\n{own[1]}"), (1, f"{passage}\n{own[2]}"), (2, prose(200))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.passages(spark, docs, "").collect()}
    assert got[2] == rows[2][1]
    assert all(passage[:60] not in got[i] and passage[-60:] not in got[i] for i in (0, 1))
    assert own[0] in got[0] and own[1] in got[0] and own[2] in got[1]


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= names

import importlib.util
import random

import __spark_entry__ as contract
import corpus_pipeline
from corpusflow.llm import queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept < known and len(kept) > 0.5 * len(known)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == sum(tokens.values())


def test_each_stage_returns_documents(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_columns_of_the_documents_stay_as_they_were(spark):
    names = ("score", "lang_pred", "familiar", "spans", "n_removed", "kept_score")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("n_chars").withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.count() > 0 and all(r[n] == f"{n} {r['doc_id']}" for r in out.collect() for n in names), name


def test_language_stage_rejects_letters_at_random_and_keeps_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(1)
    junk = [(10_000 + i, " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(draw.randint(5, 60)))) for i in range(60)]
    rows = spark.createDataFrame(junk, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "length(text) as n_chars")
    mixed = docs.unionByName(rows.withColumn("n_chars", F.col("n_chars").cast("long")))
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, mixed, FOLDER).select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.filter(r"text rlike '\\p{L}{3}'").select("doc_id").collect()}
    assert not kept & {i for i, _ in junk} and len(lettered - kept) <= 0.005 * len(lettered)
    one = mixed.filter("lang = 'en' or lang is null")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, one, FOLDER).select("doc_id").collect()}
    assert not kept & {i for i, _ in junk} and len(kept) > 500


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names) and importlib.util.find_spec("corpusflow.llm")

"""From raw documents to training sequences: five stages, each working on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import langid, lines, neardup, packing, quality
from corpusflow.llm.common import fold, spread_read
from corpusflow.session import materialize

#: A document is rejected below this probability of good quality.
GOOD = 0.3
#: A document is rejected if it has no letters, if no language holds this share of its words' probability, or if this share of its
#: words' n-grams, on the mean, was in no text of the fit (letters at random, or a language the fit has not seen).
SURE, FAMILIAR = 0.35, 0.8

ORACLE_SQL = None  # Fitted models, MinHash and tokenizers are not expressible in SQL; the stages are tested in tests/llm.


def beside(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], verdict: Callable[[DataFrame], DataFrame], *names: str) -> DataFrame:
    """The documents that ``verdict`` keeps of what ``judge`` makes of them, with their columns as they were.

    Columns of theirs that have one of the ``names`` which ``judge`` gives its own are put aside meanwhile.
    """
    aside = {}
    for name in names:
        if name in docs.columns:
            aside[name] = f"kept_{name}"
            while aside[name] in docs.columns:
                aside[name] = f"kept_{aside[name]}"
    judged = verdict(judge(docs.withColumnsRenamed(aside)))
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "quality", fold("key", 5) != 0)
    return beside(docs, lambda d: quality.score(d, model), lambda d: d.filter(F.col("score") >= GOOD), "score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose words are mostly of some language that the table names."""
    model = langid.fit(docs, fold("key", 5) != 0)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE) & (F.col("familiar") >= FAMILIAR)
    return beside(docs, lambda d: langid.label(d, model), lambda d: d.filter(known), "lang_pred", "score", "familiar", "spans")


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; those that lose all their words go."""

    def kept(cut: DataFrame) -> DataFrame:
        rows = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \x09-\x0D]"))
        if "n_chars" not in cut.columns:
            return rows
        return rows.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")))

    return beside(docs, lines.line_dedup, kept, "n_removed")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("lines", own_lines),
    ("near_duplicates", distinct_documents),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder and read again."""
    docs = spread_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

"""Documents to chunks, and rows to batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators.scale import each, join_alike, with_position


def unary_chunks(docs: DataFrame, text: str = "text", *more: str) -> DataFrame:
    """One chunk per document: (doc_id, offset 0, text, weight 1, doc_type 1 for text), and more columns if named."""
    return docs.select(
        "doc_id",
        F.lit(0).alias("offset"),
        F.col(text).alias("text"),
        F.lit(1.0).alias("weight"),
        F.lit(1).alias("doc_type"),
        *more,
    )


def sentence_chunks(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """One chunk per sentence, offset from 0 within the document.  A document without text has none."""
    source = F.col(text) if isinstance(text, str) else text
    rows = each(docs.withColumn("_text", source), X.sentences(F.col("_text")), "text", ["doc_id"], "offset")
    return rows.withColumn("weight", F.lit(1.0))


def json_chunks(docs: DataFrame, payload: str = "payload", key: str = "data") -> DataFrame:
    """Sentence chunks of the text held under ``key`` in a JSON payload; payloads without it give none."""
    return sentence_chunks(docs, F.get_json_object(payload, f"$.{key}"))


def pad_to_batch(df: DataFrame, batch: str, tokens: str, pad: int | str = 0, name: str = "padded") -> DataFrame:
    """Right-pad every token list to the longest of its batch.

    The longest length is combined map-side and joined back, so a large batch is never brought together.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_longest"))
    element = df.schema[tokens].dataType.elementType
    filler = F.array_repeat(F.lit(pad).cast(element), F.col("_longest") - F.size(tokens))
    return join_alike(df, longest, [batch]).withColumn(name, F.concat(F.col(tokens), filler)).drop("_longest")


def batch_ids(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "batch_id") -> DataFrame:
    """Number rows in order and cut them into batches of ``size``; the last batch may be shorter."""
    numbered = with_position(df, order, "_position")
    return numbered.withColumns(
        {name: F.floor(F.col("_position") / size), "slot": F.pmod("_position", F.lit(size))}
    ).drop("_position")


def batches(df: DataFrame, order: Sequence[str | Column], size: int, columns: Sequence[str]) -> DataFrame:
    """Column-wise batches: per batch one list per column, in order.  A list holds at most ``size`` values."""
    rows = batch_ids(df, order, size).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", *columns))).alias("_rows")
    )
    return rows.select("batch_id", F.size("_rows").alias("n"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(pandas frame) -> pandas frame`` to Arrow batches; spark.sql.execution.arrow.maxRecordsPerBatch
    is the batch size.  For work whose result does not depend on which rows share a batch."""
    return df.mapInPandas(lambda frames: (fn(frame) for frame in frames), schema)

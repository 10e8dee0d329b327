"""Rows to request texts (index, train, query), their export, and the answer text of a response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import salted_join
from corpusflow.session import materialize

MODES = ("index", "train", "query")


def rows_to_json(df: DataFrame, columns: Sequence[str] | None = None, name: str = "value") -> DataFrame:
    """One JSON object per row.  Null values are written, so every object has all keys."""
    return df.select("*", json_object(columns or df.columns).alias(name))


def json_object(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rows_to_raw(df: DataFrame, columns: Sequence[str], name: str = "value") -> DataFrame:
    """Data columns as text, joined without a separator."""
    return df.select("*", F.concat(*[F.col(c).cast("string") for c in columns]).alias(name))


def index_request(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``{"data": <second column>, <all columns>}``; a column named data keeps its own value."""
    columns = list(columns or df.columns)
    if len(columns) < 2:
        raise ValueError("index requests need at least two columns")
    lead = [] if "data" in columns else [F.col(columns[1]).alias("data")]
    return F.to_json(F.struct(*lead, *columns), {"ignoreNullFields": "false"})


def train_request(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return json_object(columns or df.columns)


def query_request(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.col((columns or df.columns)[0]).cast("string")


def requests(df: DataFrame, mode: str, limit: int | None = None, columns: Sequence[str] | None = None, name: str = "value") -> DataFrame:
    """The rows with their request text for one mode; exactly ``limit`` rows if given."""
    builders = {"index": index_request, "train": train_request, "query": query_request}
    if mode not in builders:
        raise ValueError(f"{mode!r} is not valid, choose one of {MODES}")
    rows = df if limit is None else df.limit(limit)
    return rows.select("*", builders[mode](df, columns).alias(name))


def framed(value: Column) -> Column:
    """Escape backslashes and line breaks so that one request stays one line."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit("\n"), F.lit("\\n"))
    return F.replace(escaped, F.lit("\r"), F.lit("\\r"))


def export_requests(df: DataFrame, path: str, name: str = "value") -> None:
    """Write requests newline-delimited.  JSON requests already escape line breaks; escaping is for query text."""
    df.select(F.col(name).alias("value")).write.mode("error").text(path)


def answer_text(body: Column) -> Column:
    """Text of the first chunk of the first hit in a JSON response, also when wrapped as ``{"res": [json]}``."""
    path = "$.search.topkResults[0].doc.chunks[0].text"
    wrapped = F.get_json_object(body, "$.res[0]")
    return F.get_json_object(F.coalesce(wrapped, body), path)


def top_answers(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per request the first chunk's text of its best hit: (request_id, doc_id, text)."""
    best = materialize(hits.filter(F.col("rank") == 1).select("request_id", "doc_id"), "best")
    wanted = chunks.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    return salted_join(best, first_chunks(wanted), "doc_id").select("request_id", "doc_id", "text")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) of each document's lowest offset."""
    first = chunks.groupBy("doc_id").agg(F.min(F.struct("offset", "text")).alias("c"))
    return first.select("doc_id", F.col("c.text").alias("text"))

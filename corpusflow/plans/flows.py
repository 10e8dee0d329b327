"""Composite flows: index, query, fact check, keyword rerank, train.

The byte encoding of the texts is a transport format of fixed width.  ``max_bytes`` applies it and
cuts longer texts; by default the flows carry whole texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import chunks as C
from corpusflow.operators import docstore, examples, fulltext, keyword, models, rerank, routing
from corpusflow.operators.fulltext import TextIndex
from corpusflow.session import materialize, scratch_path


def transported(chunks: DataFrame, max_bytes: int | None) -> DataFrame:
    """Chunk texts as they come out of the byte encoding."""
    if max_bytes is None:
        return chunks
    return chunks.withColumn("text", X.byte_decode(X.byte_encode(F.col("text"), max_bytes)))


@dataclass(frozen=True)
class CorpusIndex:
    """A document store (doc_id, text) and the standing full-text index of it."""

    store: DataFrame
    fulltext: TextIndex

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, max_bytes: int | None = None, **analysis) -> CorpusIndex:
        """Write the store, then the index from the written store, so the input is read once."""
        spark = docs.sparkSession
        path = path or scratch_path(spark, "corpus")
        docstore.write_store(docs.select("doc_id", "text"), f"{path}/store", mode="overwrite")
        store = spark.read.parquet(f"{path}/store").drop("bucket")
        return cls(store, fulltext.build(transported(C.unary_chunks(store), max_bytes), f"{path}/fulltext", **analysis))


def index_flow(
    messages: DataFrame, seq: str = "seq", path: str | None = None, max_bytes: int | None = None, **analysis
) -> CorpusIndex:
    """Index messages (kind, doc_id, text, seq): block training, keep each document's latest text, index and store it."""
    docs = routing.block(messages, ["train"]).select("doc_id", "text", seq)
    return CorpusIndex.build(docstore.upsert(None, docs, seq=seq), path, max_bytes, **analysis)


def query_flow(
    messages: DataFrame, index: CorpusIndex, weights: Mapping[str, float], match: str = "all", max_bytes: int | None = None
) -> DataFrame:
    """Search messages (kind, request_id, text, top_k) to reranked hits (request_id, rank, doc_id, score, text, found).

    Full-text search finds the ``top_k`` best chunks of each request; the request's text meets its hits again (a
    rendezvous, so a repeated request counts once), and the linear scorer orders the pairs.  A hit whose document is not
    stored has ``found`` false and no rank; a request without hits has one row of nulls.
    """
    asked = routing.block(messages, ["train"]).select("request_id", "text", "top_k")
    requests = materialize(routing.first_message(asked, "request_id", []), "requests")
    hits = materialize(fulltext.search(index.fulltext, transported(requests, max_bytes), match=match), "hits")
    scored = _scored(requests, hits, C.unary_chunks(index.store), weights)
    best = rerank.rerank(scored, F.col("top_k"), requests)
    best = best.select("request_id", "rank", "doc_id", "score", F.col("candidate").alias("text"), F.col("rank").isNotNull().alias("found"))
    lost = hits.select("request_id", "doc_id").distinct().join(scored.select("request_id", "doc_id"), ["request_id", "doc_id"], "left_anti")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("rank", "int"), ("score", "double"), ("text", "string"))]
    lost = lost.select("request_id", nothing[0], "doc_id", *nothing[1:], F.lit(False).alias("found"))
    # A request with lost hits only is reported by these.
    alone = best.filter("rank is null").join(lost, "request_id", "left_anti")
    return best.filter("rank is not null").unionByName(alone).unionByName(lost)


def _scored(requests: DataFrame, hits: DataFrame, chunks: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(request_id, top_k, doc_id, candidate, score) of each request with each of its hit documents."""
    pairs = rerank.candidate_pairs(requests, hits, chunks)
    scored = rerank.pair_features(pairs).withColumn("score", F.round(rerank.linear_score(weights), 6))
    wanted = requests.groupBy("request_id").agg(F.max("top_k").alias("top_k"))
    # Read for the ranking and for what is missing.
    return materialize(scored.select("request_id", "doc_id", "candidate", "score").join(wanted, "request_id"), "scored")


def fact_index_flow(
    rows: DataFrame, key: str = "data", seq: str | None = None, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """JSON rows (doc_id, payload[, seq]) to (keyword index, document store, receipts, pending).

    The store keeps one row per document: its last write by ``seq``, else its greatest payload.  Index and store
    each report a part for every document they took; a receipt (doc_id, chunks) is the reduce of both, and
    ``pending`` lists documents of which a part is missing.
    """
    order = seq or "payload"
    docs = rows.select("doc_id", "payload", *([seq] if seq else []))
    store = materialize(docs.groupBy("doc_id").agg(F.max(F.struct(order, "payload") if seq else F.struct("payload")).alias("m")).select("doc_id", "m.payload"), "store")
    chunks = materialize(C.json_chunks(store, key=key), "chunks")
    index = keyword.build_index(transported(chunks, max_bytes))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    taken = store.filter("doc_id is not null").select("doc_id").join(counts, "doc_id", "left").fillna(0.0, ["score"])

    def part(name: str, rows: DataFrame, doc: Column, score: Column) -> DataFrame:
        return rows.select(F.col("doc_id").alias("request_id"), F.lit(name).alias("part"), doc.alias("doc_id"), F.lit(0).alias("offset"), score.alias("score"))

    stored = part("store", store.filter("payload is not null"), F.lit(None).cast("long"), F.lit(None).cast("double"))
    merged, pending = routing.reduce_parts(part("keyword", taken, F.col("doc_id"), F.col("score")).unionByName(stored), 2, 1)
    receipts = merged.select("doc_id", F.col("score").cast("long").alias("chunks"))
    return index, store, receipts, pending.withColumnRenamed("request_id", "doc_id")


def fact_query_flow(
    queries: DataFrame, index: DataFrame, store: DataFrame, k: int | None, max_bytes: int | None = None, dim: int = 64
) -> DataFrame:
    """Fact check (request_id, text[, top_k]): sentences, keyword hits, their stored documents, and ``dim``-d embeddings, reduced.

    One row per request and hit: (request_id, rank, doc_id, offset, relevance, found, payload, embedding).
    Relevance sums the occurrences over the request's sentences; ``payload`` is the stored document (null, and ``found``
    false, if it is not stored); ``embedding`` is the request's character embedding.  A request without hits has one
    row with its embedding.  Without ``k`` each request's own ``top_k`` counts.
    """
    renamed = queries.select(F.col("request_id").alias("doc_id"), "text")
    sentences = C.sentence_chunks(renamed).select(F.col("doc_id").alias("request_id"), F.col("offset").alias("sentence"), "text")
    found = keyword.match(transported(sentences, max_bytes), index, key=("request_id", "sentence"))
    hits = found.groupBy("request_id", "doc_id", "offset").agg(F.sum("relevance").alias("score"))
    vectors = materialize(queries.select("request_id", X.char_embedding(F.col("text"), dim).alias("embedding")), "embeddings")
    # Two parts per request: its hits (one empty row if there are none) and its embedding.
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("double").alias("score")]
    hits = materialize(hits.select("request_id", "doc_id", "offset", "score"), "hits")
    without = vectors.select("request_id").join(hits, "request_id", "left_anti").select("request_id", *none)
    parts = hits.unionByName(without).withColumn("part", F.lit("keyword"))
    parts = parts.unionByName(vectors.select("request_id", *none).withColumn("part", F.lit("embedding")))
    merged, _ = routing.reduce_parts(parts, 2, k, queries if k is None else None)
    attached = docstore.joint_search(merged.withColumnRenamed("score", "relevance"), store.select("doc_id", "payload"))
    rows = vectors.join(attached, "request_id", "left")
    return rows.select("request_id", "rank", "doc_id", "offset", "relevance", F.coalesce("found", F.lit(False)).alias("found"), "payload", "embedding")


def keyword_rerank_flow(
    queries: DataFrame, chunks: DataFrame, weights: Mapping[str, float], max_bytes: int | None = None
) -> DataFrame:
    """Keyword hits per request (request_id, text, top_k), reranked as (query, chunk) pairs: (request_id, rank, doc_id, score).

    A request's own ``top_k`` bounds its hits and what comes back; a request without hits has one row of nulls.
    """
    index = keyword.build_index(transported(chunks, max_bytes))
    hits = keyword.search(transported(queries, max_bytes), index)
    best = rerank.rerank(_scored(queries, hits, chunks, weights), F.col("top_k"), queries)
    return best.select("request_id", "rank", "doc_id", "score")


def train_flow(
    rows: DataFrame, columns: Sequence[str], labels: Sequence[str], epochs: int = 20, test: DataFrame | None = None
) -> tuple[models.TextModel, DataFrame]:
    """Rows (texts..., label) to a trained classifier and its evaluation on ``test`` rows (the training rows if not given)."""
    data = examples.examples(rows, columns)
    model = models.train(data, "classification", labels, epochs=epochs, pair=len(columns) == 3)
    known, _ = examples.index_labels(data if test is None else examples.examples(test, columns), labels)
    scored = model.transform(known)
    loss = models.negative_log_likelihood(F.col("scores"), F.col("label_index"))
    return model, models.evaluate(scored, loss=loss)

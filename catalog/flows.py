"""Queries for the composite flows and the plug-in points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import query, table
from catalog.routing import WEIGHTED_SQL, WEIGHTS, _RERANK
from catalog.search import asked_items, doc_queries, indexed_docs, item_chunks
from catalog.sql import KEYWORD_HITS, sentence_rows, starts, tokens
from corpusflow.operators import chunks as C
from corpusflow.operators.scale import top_k
from corpusflow.plans import flows, plugins


def index_messages(docs):
    """Documents as index messages; those of one source pose as training messages and must be blocked."""
    kind = F.when(F.col("source") == "src0", "train").otherwise("index")
    return docs.select(kind.alias("kind"), "doc_id", "text", F.lit(0).alias("seq"))


INDEXED_SQL = f"SELECT doc_id, len({tokens('text')})::INT AS n_terms, md5(text) AS digest FROM documents WHERE source IS DISTINCT FROM 'src0'"


def index_summary(index, store):
    sizes = index.chunks.select("doc_id", "n_terms")
    return sizes.join(store.select("doc_id", F.md5("text").alias("digest")), "doc_id")


@query("flow_index", INDEXED_SQL)
def flow_index(spark, folder):
    index = flows.index_flow(index_messages(table(spark, folder, "documents", spread=True)))
    return index_summary(index.fulltext, index.store)  # both are read back from where the flow keeps them


#: Candidates are as many as each request asks for.
_FLOW_QUERY = _RERANK.replace("WHERE rank <= 10", "WHERE rank <= 1 + request_id % 5")


@query(
    "flow_query",
    f"""{_FLOW_QUERY}, stored AS (SELECT * FROM features WHERE doc_id % 7 <> 0),
          ordered AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY round({WEIGHTED_SQL}, 6) DESC, doc_id)::INT AS rank,
                          doc_id, round({WEIGHTED_SQL}, 6) AS score, md5(candidate) AS digest, true AS found FROM stored)
        SELECT * FROM ordered
        UNION ALL SELECT request_id, NULL, doc_id, NULL, NULL, false FROM features WHERE doc_id % 7 = 0
        UNION ALL SELECT item_id + 1000000, NULL, NULL, NULL, NULL, false FROM benchmark""",
)
def flow_query(spark, folder):
    """Requests with their own top_k, each sent twice; others without any hit; one document in seven not stored."""
    docs = table(spark, folder, "documents", spread=True).select("doc_id", "text")
    index = flows.CorpusIndex(docs.filter("doc_id % 7 <> 0"), indexed_docs(spark, folder))
    searches = asked_items(spark, folder).select(F.lit("search").alias("kind"), "request_id", "text", "top_k")
    noise = searches.withColumns({"kind": F.lit("train"), "request_id": -1 - F.col("request_id")})
    empty = searches.withColumns({"request_id": 1_000_000 + F.col("request_id"), "text": F.lit("qqqqzzzzqqqq")})
    messages = searches.unionByName(searches).unionByName(noise).unionByName(empty)
    hits = flows.query_flow(messages, index, WEIGHTS, match="any")
    return hits.select("request_id", "rank", "doc_id", "score", F.md5("text").alias("digest"), "found")


def payloads(df):
    return df.select("doc_id", F.to_json(F.struct(F.col("text").alias("data"))).alias("payload"))


@query(
    "flow_fact_index",
    f"""WITH chunks AS ({sentence_rows('documents', 'doc_id')}),
        owners AS (SELECT text, max(doc_id) AS doc_id FROM chunks GROUP BY 1),
        owned AS (SELECT doc_id, count(*) AS patterns FROM owners GROUP BY 1)
        SELECT doc_id, count(text) AS chunks, coalesce(max(patterns), 0)::BIGINT AS patterns, true AS complete
        FROM (SELECT doc_id FROM documents) LEFT JOIN chunks USING (doc_id) LEFT JOIN owned USING (doc_id) GROUP BY 1
        UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 END, CASE WHEN doc_id % 2 = 0 THEN 0 END, doc_id % 2 = 0 FROM documents WHERE doc_id < 10""",
)
def flow_fact_index(spark, folder):
    """Documents written twice, documents without sentences, and documents whose payload never came."""
    docs = payloads(table(spark, folder, "documents", spread=True)).withColumn("seq", F.lit(1))
    earlier = docs.withColumns({"payload": F.lit('{"data": "An earlier text."}'), "seq": F.lit(0)})
    few = docs.filter("doc_id < 10")
    odd = few.withColumns({"payload": F.when(F.col("doc_id") % 2 == 0, F.lit('{"data": ""}')), "doc_id": -1 - F.col("doc_id")})
    index, _, receipts, pending = flows.fact_index_flow(docs.unionByName(earlier).unionByName(odd), seq="seq")
    owned = index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("patterns"))
    done = receipts.join(owned, "doc_id", "left").fillna(0, ["patterns"]).withColumn("complete", F.lit(True))
    nothing = F.lit(None).cast("long")
    return done.unionByName(pending.select("doc_id", nothing.alias("chunks"), nothing.alias("patterns"), F.lit(False).alias("complete")))


_FACT_QUERY = f"""WITH patterns AS (SELECT text, arg_max(doc_id, (doc_id, "offset")) AS doc_id, arg_max("offset", (doc_id, "offset")) AS "offset"
                          FROM ({sentence_rows('benchmark', 'item_id')}) t(doc_id, "offset", text) GROUP BY 1),
        asked AS (SELECT doc_id AS request_id, text FROM ({sentence_rows('documents', 'doc_id')})),
        hits AS (SELECT a.request_id, p.doc_id, p."offset", sum(len({starts('a.text', 'p.text')}))::DOUBLE AS relevance
                 FROM asked a JOIN patterns p ON contains(a.text, p.text) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, doc_id, "offset")::INT AS rank FROM hits),
        letters AS (SELECT doc_id AS request_id, regexp_extract_all(text, '(?s).') AS l FROM documents),
        grams AS (SELECT request_id, unnest(list_transform(range(1, len(l) - 1), lambda i: (((unicode(l[i]) * 131 + unicode(l[i + 1])) * 131 + unicode(l[i + 2])) * 40503::BIGINT >> 16) % 64)) AS cell FROM letters),
        counts AS (SELECT request_id, cell, count(*) AS n FROM grams GROUP BY 1, 2),
        norms AS (SELECT request_id, round(sum(n) / sqrt(sum(n * n)), 6) AS norm1, round(sum(cell * n) / sqrt(sum(n * n)), 6) AS weighted FROM counts GROUP BY 1)
        SELECT d.doc_id AS request_id, rank, r.doc_id, "offset", relevance, r.doc_id IS NOT NULL AND r.doc_id % 5 <> 0 AS found,
               CASE WHEN r.doc_id % 5 <> 0 THEN md5('{{"data":' || to_json(b.text) || '}}') END AS digest, coalesce(norm1, 0) AS norm1, coalesce(weighted, 0) AS weighted
        FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.request_id = d.doc_id LEFT JOIN norms n ON n.request_id = d.doc_id
        LEFT JOIN benchmark b ON b.item_id = r.doc_id"""


@query("flow_fact_query", _FACT_QUERY)
def flow_fact_query(spark, folder):
    return _fact_query(spark, folder, doc_queries(spark, folder), 5)


@query("flow_fact_query_own_k", _FACT_QUERY.replace("WHERE rank <= 5", "WHERE rank <= 1 + request_id % 4"))
def flow_fact_query_own_k(spark, folder):
    """The same with a number of hits per request."""
    return _fact_query(spark, folder, doc_queries(spark, folder).withColumn("top_k", (1 + F.col("request_id") % 4).cast("int")), None)


def _fact_query(spark, folder, asked, k):
    facts = payloads(table(spark, folder, "benchmark").withColumnRenamed("item_id", "doc_id"))
    index, store, _, _ = flows.fact_index_flow(facts)
    rows = flows.fact_query_flow(asked, index, store.filter("doc_id % 5 <> 0"), k)
    # The whole documents and vectors come back; they are compared by sums that tell their cells apart.
    norm1 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    sums = [F.coalesce(F.round(c, 6), F.lit(0.0)).alias(n) for c, n in ((norm1, "norm1"), (weighted, "weighted"))]
    return rows.select("request_id", "rank", "doc_id", "offset", "relevance", "found", F.md5("payload").alias("digest"), *sums)


@query(
    "flow_keyword_rerank",
    f"""WITH {KEYWORD_HITS},
        sets AS (SELECT r.request_id, r.doc_id, d.text AS query, b.text AS candidate,
                   list_distinct({tokens('d.text')}) AS q, list_distinct({tokens('b.text')}) AS c
                 FROM ranked r JOIN documents d ON d.doc_id = r.request_id JOIN benchmark b ON b.item_id = r.doc_id WHERE rank <= 1 + r.request_id % 3),
        features AS (SELECT request_id, doc_id, len(list_intersect(q, c))::DOUBLE AS shared,
                       len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))) AS jaccard,
                       least(length(query), length(candidate)) / greatest(length(query), length(candidate)) AS length_ratio,
                       contains(candidate, query)::INT::DOUBLE AS contains FROM sets)
        SELECT d.doc_id AS request_id, f.doc_id, score, rank FROM documents d
        LEFT JOIN (SELECT request_id, doc_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id)::INT AS rank
                   FROM (SELECT request_id, doc_id, round({WEIGHTED_SQL}, 6) AS score FROM features)) f ON f.request_id = d.doc_id""",
)
def flow_keyword_rerank(spark, folder):
    asked = doc_queries(spark, folder).withColumn("top_k", (1 + F.col("request_id") % 3).cast("int"))
    return flows.keyword_rerank_flow(asked, item_chunks(spark, folder), WEIGHTS)


@query("flow_train", "SELECT metric, true AS reaches_floor FROM (VALUES ('acc'), ('loss')) t(metric) WHERE (SELECT count(*) FROM documents) > 0")
def flow_train(spark, folder):
    """English or not, learnt from four of five documents and scored on the fifth."""
    docs = table(spark, folder, "documents", spread=True)
    rows = docs.select("doc_id", "text", F.when(F.col("lang") == "en", "1").otherwise("0").alias("label"))
    parts = [rows.filter(f"doc_id % 5 {sign} 0").select("text", "label") for sign in ("<>", "=")]
    results = flows.train_flow(parts[0], ["text", "label"], ["0", "1"], epochs=10, test=parts[1])[1]
    good = F.when(F.col("metric") == "acc", F.col("value") >= 0.95).otherwise(F.col("value") <= 0.3)
    return results.select("metric", good.alias("reaches_floor"))


def text_shape(texts: list[str]) -> np.ndarray:
    """Example encoder: length, digits, and spaces of each text."""
    return np.array([[len(t), sum(c in "0123456789" for c in t), t.count(" ")] for t in texts], dtype=np.float32)


@query(
    "udf_encoder",
    """SELECT doc_id, length(text)::DOUBLE AS size, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits,
       (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM documents""",
)
def udf_encoder(spark, folder):
    vector = plugins.encoder(text_shape)(F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", vector.alias("v"))
    return rows.select("doc_id", *[F.col("v")[i].cast("double").alias(n) for i, n in enumerate(("size", "digits", "spaces"))])


@query(
    "udf_scorer",
    """SELECT u.conv_id, u.turn, length(a.text) / length(u.text) AS score FROM conversations u
       JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
)
def udf_scorer(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    ratio = plugins.scorer(lambda queries, candidates: np.array([len(c) / len(q) for q, c in zip(queries, candidates)]))
    pairs = turns.withColumnRenamed("text", "query").join(nexts, ["conv_id", "turn"])
    return plugins.router(pairs, lambda df: df.select("conv_id", "turn", ratio("query", "candidate").alias("score")))


class DigestIndexer:
    """Example user index: chunks by the md5 of their text, found by equal text."""

    def build(self, chunks):
        return chunks.select(F.md5("text").alias("digest"), "doc_id", "offset")

    def search(self, index, queries, k):
        # k per digest first: texts copied many times then send k rows, not all of them.
        first = top_k(index, ["digest"], [F.asc("doc_id"), F.asc("offset")], k)
        return queries.select("request_id", F.md5("text").alias("digest")).join(first, "digest").drop("digest")


@query(
    "custom_index",
    f"""WITH chunks AS ({sentence_rows('documents', 'doc_id')}),
        asked AS (SELECT item_id * 1000 + "offset" AS request_id, text FROM ({sentence_rows('benchmark', 'item_id')}))
        SELECT * FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY doc_id, "offset")::INT AS rank, doc_id, "offset"
                       FROM asked JOIN chunks USING (text)) WHERE rank <= 3""",
)
def custom_index(spark, folder):
    chunks = C.sentence_chunks(table(spark, folder, "documents", spread=True))
    asked = C.sentence_chunks(table(spark, folder, "benchmark").withColumnRenamed("item_id", "doc_id"))
    queries = asked.select((F.col("doc_id") * 1000 + F.col("offset")).alias("request_id"), "text")
    return plugins.run_indexer(DigestIndexer(), chunks, queries, 3)

"""Queries for message routing, reduce, pairing and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.search import indexed_docs, items, whole_docs
from catalog.sql import ANY, PAIRS, fulltext as ft, ranked, tokens
from catalog.texts import conversation_pairs
from corpusflow.operators import fulltext, rerank, routing
from corpusflow.session import materialize

# Explicit scorer weights used by the reranking queries.
WEIGHTS = {"shared": 0.1, "jaccard": 2.0, "length_ratio": 0.5, "contains": 1.5}
WEIGHTED_SQL = "0.1 * shared + 2.0 * jaccard + 0.5 * length_ratio + 1.5 * contains"


def messages(spark, folder):
    """Events as messages: the event type is the kind."""
    return table(spark, folder, "events").withColumnRenamed("event_type", "kind")


@query("block_filter", "SELECT event_id, event_type AS kind, user_id FROM events WHERE event_type NOT IN ('view', 'error')")
def block_filter(spark, folder):
    return routing.block(messages(spark, folder), ["view", "error"]).select("event_id", "kind", "user_id")


@query("block_none", "SELECT event_id, event_type AS kind FROM events")
def block_none(spark, folder):
    return routing.block(messages(spark, folder), []).select("event_id", "kind")


@query("kind_stats", "SELECT event_type AS kind, count(*) AS messages FROM events GROUP BY 1")
def kind_stats(spark, folder):
    return routing.kind_stats(messages(spark, folder))


@query(
    "kind_dispatch",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'search' ELSE 'train' END AS branch, round(value * CASE event_type WHEN 'click' THEN 1 ELSE 2 END, 6) AS value
       FROM events WHERE event_type IN ('click', 'purchase')""",
)
def kind_dispatch(spark, folder):
    branches = routing.dispatch(
        messages(spark, folder),
        {
            "click": lambda df: df.select("event_id", F.lit("search").alias("branch"), F.round("value", 6).alias("value")),
            "purchase": lambda df: df.select("event_id", F.lit("train").alias("branch"), F.round(F.col("value") * 2, 6).alias("value")),
        },
    )
    return branches["click"].unionByName(branches["purchase"])


_PARTS = """
  parts AS (SELECT event_id // 12 AS request_id, event_type AS part, user_id % 7 AS doc_id, 0::INT AS "offset", value AS score FROM events),
  arrived AS (SELECT request_id, count(DISTINCT part) AS arrived FROM parts GROUP BY 1)"""


def _parts(spark, folder):
    return table(spark, folder, "events").select(
        F.expr("event_id div 12").alias("request_id"),
        F.col("event_type").alias("part"),
        (F.col("user_id") % 7).alias("doc_id"),
        F.lit(0).alias("offset"),
        F.col("value").alias("score"),
    )


@query(
    "reduce_parts",
    f"""WITH {_PARTS},
        merged AS (SELECT request_id, doc_id, "offset", max(score) AS score FROM parts
                   WHERE request_id IN (SELECT request_id FROM arrived WHERE arrived = 5) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id, "offset")::INT AS rank FROM merged)
        WHERE rank <= 3""",
)
def reduce_parts(spark, folder):
    return routing.reduce_parts(_parts(spark, folder), 5, 3)[0]


@query(
    "reduce_parts_own_k",
    f"""WITH {_PARTS},
        merged AS (SELECT request_id, doc_id, "offset", max(score) AS score FROM parts
                   WHERE request_id IN (SELECT request_id FROM arrived WHERE arrived = 5) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id, "offset")::INT AS rank FROM merged)
        WHERE rank <= request_id % 4""",
)
def reduce_parts_own_k(spark, folder):
    """The same with a number of hits per request, none for some."""
    own = (F.col("request_id") % 4).cast("int")
    return routing.reduce_parts(_parts(spark, folder).withColumn("top_k", own), 5, None)[0]


@query("reduce_pending", f"WITH {_PARTS} SELECT request_id, arrived FROM arrived WHERE arrived < 5")
def reduce_pending(spark, folder):
    return routing.reduce_parts(_parts(spark, folder), 5, 3)[1]


@query(
    "rendezvous",
    """WITH asked AS (SELECT user_id AS request_id, min(event_id) AS request_event FROM events WHERE event_type = 'click' GROUP BY 1)
       SELECT request_id, request_event, event_id AS response_event, value FROM asked JOIN events ON user_id = request_id WHERE event_type = 'purchase'""",
)
def rendezvous(spark, folder):
    events = messages(spark, folder).select(F.col("user_id").alias("request_id"), "event_id", "value", "kind")

    requests = events.filter("kind = 'click'").select("request_id", F.col("event_id").alias("request_event"))
    hits = events.filter("kind = 'purchase'").select("request_id", F.col("event_id").alias("response_event"), "value")
    # Every response row arrives twice and counts once; a response of several rows keeps them all.
    return routing.rendezvous(requests, hits.unionByName(hits), order=["request_event"], within=["response_event"])


_RERANK = f"""
  WITH {ft()}, {ranked(ANY, 10)},
  pairs AS (SELECT h.request_id, b.text AS query, h.doc_id, d.text AS candidate
            FROM best h JOIN benchmark b ON b.item_id = h.request_id JOIN documents d USING (doc_id)),
  sets AS (SELECT *, list_distinct({tokens('query')}) AS q, list_distinct({tokens('candidate')}) AS c FROM pairs),
  features AS (
    SELECT request_id, doc_id, query, candidate,
      len(list_intersect(q, c))::DOUBLE AS shared,
      len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))) AS jaccard,
      least(length(query), length(candidate)) / greatest(length(query), length(candidate)) AS length_ratio,
      contains(candidate, query)::INT::DOUBLE AS contains
    FROM sets),
  weights AS (SELECT qt.request_id, qt.term, ln((nn.n + 1) / (d.df + 1)) AS idf FROM qt JOIN dfs d USING (term) CROSS JOIN nn),
  common_idf AS (SELECT w.request_id, p.doc_id, sum(idf) AS idf_overlap
               FROM weights w JOIN post p USING (term) JOIN pairs x ON x.request_id = w.request_id AND x.doc_id = p.doc_id GROUP BY ALL)
"""


def _hits(spark, folder):
    return fulltext.search(indexed_docs(spark, folder), items(spark, folder), 10, match="any")


@query("candidate_pairs", f"{_RERANK} SELECT request_id, query, doc_id, candidate FROM pairs")
def candidate_pairs(spark, folder):
    return _pairs(spark, folder).select("request_id", "query", "doc_id", "candidate")


def _pairs(spark, folder):
    return rerank.candidate_pairs(items(spark, folder), _hits(spark, folder), whole_docs(spark, folder))


def _idf(spark, folder):
    index = indexed_docs(spark, folder)
    n = index.size
    return index.term_stats().select("term", fulltext.idf(F.lit(n), F.col("df")).alias("idf"))


@query(
    "rerank_score",
    f"""{_RERANK} SELECT request_id, doc_id, shared, round(jaccard, 6) AS jaccard, round(length_ratio, 6) AS length_ratio, contains,
        round(idf_overlap, 6) AS idf_overlap, round({WEIGHTED_SQL} + 0.01 * idf_overlap, 6) AS score
        FROM features JOIN common_idf USING (request_id, doc_id)""",
)
def rerank_score(spark, folder):
    rows = rerank.pair_features(_pairs(spark, folder), _idf(spark, folder))
    score = F.round(rerank.linear_score({**WEIGHTS, "idf_overlap": 0.01}), 6).alias("score")
    rounded = [F.round(c, 6).alias(c) for c in ("jaccard", "length_ratio", "idf_overlap")]
    return rows.select("request_id", "doc_id", "shared", "contains", *rounded, score)


@query(
    "rerank_topk",
    f"""{_RERANK} SELECT request_id, rank, doc_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
            SELECT request_id, doc_id, round({WEIGHTED_SQL}, 6) AS score FROM features)) WHERE rank <= 3 + request_id % 3""",
)
def rerank_topk(spark, folder):
    rows = rerank.pair_features(_pairs(spark, folder))
    scored = rows.select("request_id", "doc_id", F.round(rerank.linear_score(WEIGHTS), 6).alias("score"))
    best = rerank.rerank(scored, (3 + F.col("request_id") % 3))
    return best.select("request_id", "rank", "doc_id", "score")


FITTED = f"""
  WITH {PAIRS},
  sets AS (SELECT *, list_distinct({tokens('query')}) AS q, list_distinct({tokens('candidate')}) AS c FROM pairs),
  rated AS (SELECT *, CASE WHEN len(list_distinct(list_concat(q, c))) > 0 THEN len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))) ELSE 0 END AS jaccard FROM sets),
  line AS (SELECT regr_slope(label, jaccard) AS slope, regr_intercept(label, jaccard) AS intercept, count(*) AS examples FROM rated)"""


@query("rerank_fit", f"{FITTED} SELECT conv_id, turn, label, round(intercept + slope * jaccard, 6) + 0.0 AS score FROM rated, line")
def rerank_fit(spark, folder):
    """A scorer fitted to one feature without a penalty: the least-squares line."""
    pairs = conversation_pairs(spark, folder)
    model, _ = rerank.fit_scorer(pairs.select("query", "candidate", "label"), reg=0.0, features=["jaccard"])
    scored = rerank.score_pairs(pairs, model)
    return scored.select("conv_id", "turn", "label", (F.round("score", 6) + 0.0).alias("score"))


@query("rerank_fit_all")
def rerank_fit_all(spark, folder):
    """A scorer fitted to all features, term statistics among them, with the ridge."""
    pairs, stats = conversation_pairs(spark, folder), materialize(_idf(spark, folder), "idf")  # fit and scores read it several times
    model, _ = rerank.fit_scorer(pairs.select("query", "candidate", "label"), stats)
    scored = rerank.score_pairs(pairs, model, stats)
    return scored.select("conv_id", "turn", "label", *rerank.FEATURES, "score")

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusflow.operators import rerank, routing


def test_block(spark):
    df = spark.createDataFrame([("train", 1), ("index", 2), (None, 3)], "kind string, n int")
    assert sorted(r["n"] for r in routing.block(df, ["train"]).collect()) == [2, 3]
    assert routing.block(df, []).count() == 3
    assert {r["kind"]: r["messages"] for r in routing.kind_stats(df).collect()} == {"train": 1, "index": 1, None: 1}


def test_dispatch_drops_other_kinds(spark):
    df = spark.createDataFrame([("train", 1), ("search", 2), ("other", 3)], "kind string, n int")
    out = routing.dispatch(df, {"train": lambda d: d, "search": lambda d: d.withColumn("n", F.col("n") * 10)})
    assert [r["n"] for r in out["train"].collect()] == [1] and [r["n"] for r in out["search"].collect()] == [20]


PART = "request_id long, part string, doc_id long, offset int, score double"


def test_reduce_waits_for_all_parts(spark):
    rows = [
        (1, "a", 5, 0, 0.1), (1, "b", 5, 0, 0.9), (1, "b", 6, 0, 0.5), (1, "a", 7, 0, 0.4),
        (2, "a", 5, 0, 1.0), (3, "a", None, None, None), (3, "b", 8, 0, 0.2), (2, "a", 6, 0, 1.0),
    ]
    merged, pending = routing.reduce_parts(spark.createDataFrame(rows, PART), 2, 2)
    got = sorted((r["request_id"], r["rank"], r["doc_id"], r["score"]) for r in merged.collect())
    assert got == [(1, 1, 5, 0.9), (1, 2, 6, 0.5), (3, 1, 8, 0.2)]
    assert [tuple(r) for r in pending.collect()] == [(2, 1)]


def test_rendezvous_pairs_once(spark):
    requests = spark.createDataFrame([(1, "q1", 5), (1, "q1", 5), (2, "q2", 3)], "request_id long, text string, top_k int")
    responses = spark.createDataFrame([(1, "h1"), (3, "h3"), (1, "h1")], "request_id long, hits string")
    assert [tuple(r) for r in routing.rendezvous(requests, responses).collect()] == [(1, "q1", 5, "h1")]
    rows = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 1, 7), (3, 1, 9)], "request_id long, rank int, doc_id long")
    both = routing.rendezvous(requests, rows, order=["top_k"], within=["rank"]).collect()
    assert sorted((r["request_id"], r["text"], r["rank"], r["doc_id"]) for r in both) == [(1, "q1", 1, 7), (1, "q1", 2, 8)]


def test_first_message(spark):
    df = spark.createDataFrame([(1, 5, "later"), (1, 2, "first"), (2, 9, "only")], "k int, at int, v string")
    assert sorted(map(tuple, routing.first_message(df, "k", ["at"]).collect())) == [(1, 2, "first"), (2, 9, "only")]


def pairs(spark, n=98):
    """The query and a good or a bad answer, in turn."""
    rows = [("test query", f"test query answer {i}" if i % 2 == 0 else f"nothing {i} here", float(i % 2 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "query string, candidate string, label double")


def test_pair_features(spark):
    df = spark.createDataFrame([("a b b", "b c a b b d"), ("x", ""), ("", "")], "query string, candidate string")
    stats = spark.createDataFrame([("a", 0.5), ("b", 2.0), ("c", 9.0)], "term string, idf double")
    rows = {r["query"]: r.asDict() for r in rerank.pair_features(df, stats).collect()}
    first = rows["a b b"]
    assert first["shared"] == 2 and first["jaccard"] == 0.5 and first["idf_overlap"] == 2.5
    assert first["length_ratio"] == 5 / 11 and first["contains"] == 1
    assert rows["x"]["jaccard"] == 0 and rows[""]["length_ratio"] == 0 and rows[""]["contains"] == 1
    assert all(r["idf_overlap"] == 0 for r in rerank.pair_features(df).collect())


def test_scorer_learns_the_labels(spark):
    model, status = rerank.fit_scorer(pairs(spark))
    assert status.first()["status"] == "SUCCESS" and status.first()["examples"] == 98
    scored = rerank.score_pairs(pairs(spark), model)
    means = {r["label"]: r["s"] for r in scored.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert means[1.0] > 0.9 and means[0.0] < 0.1


def test_candidate_pairs_use_the_first_chunk(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "request_id long, text string")
    hits = spark.createDataFrame([(1, 1, 7, 3), (1, 2, 7, 1), (2, 1, 8, 0), (2, 2, 99, 0)], "request_id long, rank int, doc_id long, offset int")
    chunks = spark.createDataFrame([(7, 1, "second"), (7, 0, "first"), (8, 4, "late")], "doc_id long, offset int, text string")
    got = rerank.candidate_pairs(queries, hits, chunks).select("request_id", "query", "doc_id", "candidate")
    assert sorted(map(tuple, got.collect())) == [(1, "q", 7, "first"), (2, "r", 8, "late")]


@pytest.mark.parametrize("n, k", [(98, 5), (1, 5), (5, 5), (0, 5)])
def test_rerank_returns_min_k_n(spark, n, k):
    rows = [(1, i, float(i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "request_id long, doc_id long, score double")
    got = [(r["doc_id"], r["score"]) for r in rerank.rerank(df, k).orderBy("rank").collect()]
    assert got == [(i, s) for _, i, s in sorted(rows, key=lambda r: (-r[2], r[1]))[:k]]


def test_rerank_reports_requests_without_candidates(spark):
    scored = spark.createDataFrame([(1, i, float(i), 10) for i in range(20)], "request_id long, doc_id long, score double, k int")
    requests = spark.createDataFrame([(1,), (2,), (2,)], "request_id long")
    rows = rerank.rerank(scored, F.col("k"), requests).collect()
    assert sorted((r["request_id"], r["rank"]) for r in rows if r["rank"]) == [(1, i) for i in range(1, 11)]
    assert [r["doc_id"] for r in rows if r["request_id"] == 2] == [None]


@pytest.mark.parametrize("streamed", [False, True])
def test_all_features_are_fitted(spark, streamed):
    folder = "/root/testdata/sf0.001"
    rows = contract.queries()["rerank_fit_all"](spark, folder).collect()
    x, y = np.array([[r[f] for f in rerank.FEATURES] for r in rows]), np.array([r["label"] for r in rows])
    assert all(x[:, rerank.FEATURES.index(f)].std() > 0 for f in ("shared", "idf_overlap", "jaccard", "length_ratio"))
    # Least squares with the ridge (in units of the label's deviation) as further rows, the intercept free of it.
    system = np.vstack([x - x.mean(axis=0), np.sqrt(1e-3 / y.std() * len(x)) * np.eye(x.shape[1])])
    weights = np.linalg.lstsq(system, np.concatenate([y - y.mean(), np.zeros(x.shape[1])]), rcond=None)[0]
    intercept = y.mean() - x.mean(axis=0) @ weights
    if streamed:
        last = contract.queries()["stream_train_all"](spark, folder).collect()
        got = {r["feature"]: r["weight"] for r in last}
        assert [got[f] for f in rerank.FEATURES] == pytest.approx(weights.tolist(), abs=1e-6)
        assert last[0]["intercept"] == pytest.approx(intercept, abs=1e-6) and last[0]["examples"] == len(rows)
    else:
        assert [r["score"] for r in rows] == pytest.approx((x @ weights + intercept).tolist(), abs=1e-6)

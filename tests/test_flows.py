import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import examples, rerank
from corpusflow.plans import flows, plugins
from corpusflow.session import scratch_path
from corpusflow.streaming import jobs

TEXTS = ["the red rose", "a red car", "blue summer rose garden", "nothing at all"]
WEIGHTS = {"shared": 1.0, "length_ratio": 0.5}


def messages(spark):
    rows = [("index", i, t, 1) for i, t in enumerate(TEXTS)] + [("train", 9, "red rose", 1), ("index", 1, "an old car", 0)]
    return spark.createDataFrame(rows, "kind string, doc_id long, text string, seq int")


def search_messages(spark):
    rows = [("search", 1, "red rose", 2), ("search", 1, "red rose", 2), ("search", 2, "unheard", 2), ("train", 3, "red", 2), ("search", 4, "nothing", 5)]
    return spark.createDataFrame(rows, "kind string, request_id long, text string, top_k int")


def test_index_then_query(spark):
    path = scratch_path(spark, "index")
    index = flows.index_flow(messages(spark), path=path)
    assert {r["doc_id"]: r["text"] for r in index.store.collect()} == dict(enumerate(TEXTS))
    assert spark.read.parquet(f"{path}/store").count() == 4 == index.fulltext.size
    asked = search_messages(spark)
    hits = flows.query_flow(asked, index, WEIGHTS, match="any").collect()
    got = sorted((r["request_id"], r["rank"], r["doc_id"], r["text"]) for r in hits if r["found"])
    assert got == [(1, 1, 0, "the red rose"), (1, 2, 1, "a red car"), (4, 1, 3, "nothing at all")]
    assert [(r["request_id"], r["doc_id"]) for r in hits if not r["found"]] == [(2, None)]
    partly = flows.CorpusIndex(index.store.filter("doc_id not in (1, 3)"), index.fulltext)
    lost = [(r["request_id"], r["doc_id"], r["rank"]) for r in flows.query_flow(asked, partly, WEIGHTS, match="any").collect() if not r["found"]]
    assert sorted(lost, key=str) == [(1, 1, None), (2, None, None), (4, 3, None)]
    all_terms = flows.query_flow(asked, index, WEIGHTS).filter("found").collect()
    assert sorted((r["request_id"], r["doc_id"]) for r in all_terms) == [(1, 0), (4, 3)]


def test_byte_transport_cuts_only_when_asked(spark):
    index = flows.index_flow(messages(spark), max_bytes=7).fulltext
    assert {r["term"] for r in index.postings().filter("doc_id = 1").collect()} == {"a", "red", "c"}
    assert flows.index_flow(messages(spark)).fulltext.chunks.agg(F.max("n_terms")).first()[0] == 4


def test_fact_flows(spark):
    payload = spark.createDataFrame([(i, json.dumps({"data": t})) for i, t in enumerate(["Red. Rose.", "Red.", "{}"])], "doc_id long, payload string")
    payload = payload.unionByName(spark.createDataFrame([(8, "broken"), (0, "aaa"), (9, None)], "doc_id long, payload string"))
    index, store, receipts, pending = flows.fact_index_flow(payload)
    assert {r["text"]: (r["doc_id"], r["added"]) for r in index.collect()} == {"Red.": (1, 2), "Rose.": (0, 1), "{}": (2, 1)}
    assert sorted(map(tuple, receipts.collect())) == [(0, 2), (1, 1), (2, 1), (8, 0)]
    assert [r["doc_id"] for r in pending.collect()] == [9] and store.count() == 5
    asked = spark.createDataFrame([(5, "Red. A Rose. Red."), (6, "none")], "request_id long, text string")
    got = flows.fact_query_flow(asked, index, store.filter("doc_id <> 0"), 5).orderBy("request_id", "rank").collect()
    assert [(r["request_id"], r["doc_id"], r["offset"], r["relevance"], r["found"]) for r in got] == [(5, 1, 0, 2.0, True), (5, 0, 1, 1.0, False), (6, None, None, None, False)]
    assert [r["payload"] for r in got] == ['{"data": "Red."}', None, None] and all(len(r["embedding"]) == 64 for r in got)


def test_keyword_rerank(spark):
    chunks = spark.createDataFrame([(1, 0, "rose"), (2, 0, "red rose"), (3, 0, "car")], "doc_id long, offset int, text string")
    asked = spark.createDataFrame([(1, "a red rose", 2), (2, "a red rose", 1), (3, "none", 4)], "request_id long, text string, top_k int")
    got = flows.keyword_rerank_flow(asked, chunks, WEIGHTS).collect()
    assert sorted(((r["request_id"], r["rank"], r["doc_id"]) for r in got), key=str) == [(1, 1, 2), (1, 2, 1), (2, 1, 2), (3, None, None)]


def test_as_many_hits_as_a_request_wants(spark):
    chunks = spark.createDataFrame([(i, 0, f"word{i:03d}") for i in range(150)], "doc_id long, offset int, text string")
    asked = spark.createDataFrame([(1, " ".join(f"word{i:03d}" for i in range(150)), 150)], "request_id long, text string, top_k int")
    assert flows.keyword_rerank_flow(asked, chunks, WEIGHTS).count() == 150


def test_train_flow(spark):
    rows = spark.createDataFrame([(f"{w} {i}", w) for i in range(20) for w in ("yes", "no")], "text string, label string")
    model, results = flows.train_flow(rows, ["text", "label"], ["no", "yes"])
    assert {r["metric"]: r["value"] for r in results.collect()}["acc"] == 1.0
    assert model.labels == ["no", "yes"]


def test_plugins(spark):
    df = spark.createDataFrame([("ab", "abc"), ("x", "")], "q string, c string")
    encode = plugins.encoder(lambda texts: np.array([[len(t)] for t in texts]))
    score = plugins.scorer(lambda q, c: np.array([len(b) - len(a) for a, b in zip(q, c)]))
    rows = df.select(encode(F.col("c")).alias("v"), score("q", "c").alias("s")).collect()
    assert [(r["v"], r["s"]) for r in rows] == [([3.0], 1.0), ([0.0], -1.0)]
    assert plugins.router(df, lambda d: d.filter("c <> ''")).count() == 1


def parts(spark, df, label, n=3):
    """The rows as a folder of several files, one micro-batch each."""
    path = scratch_path(spark, label)
    df.repartition(n).write.parquet(path)
    return jobs.read_files(spark, path, df.schema, "*.parquet", per_batch=1)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_streamed_index_equals_batch(spark):
    path, state = scratch_path(spark, "index"), scratch_path(spark, "state")
    rows = messages(spark).filter("seq = 1")
    run(jobs.ingest(parts(spark, rows, "in"), path, state))
    update = spark.createDataFrame([("index", 1, "a green car", 2)], rows.schema)
    more = scratch_path(spark, "more")
    update.write.parquet(more)
    index, store = jobs.read_index(spark, path)
    assert {r["doc_id"]: r["text"] for r in store.collect()} == dict(enumerate(TEXTS))
    batch = flows.index_flow(rows)
    assert sorted(map(str, index.postings().collect())) == sorted(map(str, batch.fulltext.postings().collect()))
    run(jobs.ingest(jobs.read_files(spark, more, rows.schema, "*.parquet"), f"{path}-more", f"{state}-more"))
    run(jobs.ingest(parts(spark, rows.unionByName(update), "both"), f"{path}-both", f"{state}-both"))
    index, store = jobs.read_index(spark, f"{path}-both")
    assert {r["doc_id"]: r["text"] for r in store.collect()}[1] == "a green car"
    terms = {r["term"] for r in index.postings().filter("doc_id = 1").collect()}
    assert terms == {"a", "green", "car"}


def test_streamed_search_equals_batch(spark):
    from corpusflow.operators import fulltext as T

    index = flows.index_flow(messages(spark)).fulltext
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["red", "rose", "red rose", "blue car"])], "request_id long, text string")
    path, state = scratch_path(spark, "hits"), scratch_path(spark, "state")
    run(jobs.search(parts(spark, asked, "asked"), index, 2, path, state, match="any"))
    got = spark.read.parquet(path).drop("batch_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.search(index, asked, 2, "any").collect()))


def test_streamed_rendezvous(spark):
    at = F.timestamp_seconds(1_700_000_000 + F.col("t")).alias("ts")
    requests = spark.createDataFrame([(1, 0, "q1"), (2, 5, "q2"), (3, 9, "q3"), (1, 0, "q1")], "request_id long, t long, text string")
    responses = spark.createDataFrame([(2, 1, "h2"), (1, 30, "h1"), (3, 5000, "late"), (4, 7, "h4")], "request_id long, t long, hits string")
    left = parts(spark, requests.select("request_id", at, "text"), "requests", 1)
    right = parts(spark, responses.select("request_id", at, "hits"), "responses", 1)
    path, state = scratch_path(spark, "pairs"), scratch_path(spark, "state")
    run(jobs.write_stream(jobs.rendezvous(left, right, "10 minutes").select("request_id", "text", "hits"), path, state))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "q1", "h1"), (2, "q2", "h2")]


def test_streamed_training_equals_one_fit(spark):
    rows = [("test query", f"test query answer {i}" if i % 2 else f"nothing {i} here", float(i % 2)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "query string, candidate string, label double")
    path, state = scratch_path(spark, "scorer"), scratch_path(spark, "state")
    with pytest.raises(FileNotFoundError):
        jobs.latest_scorer(spark, path)
    run(jobs.train_scorer(parts(spark, pairs, "pairs"), path, state))
    status = spark.read.parquet(f"{path}/status").orderBy("step").collect()
    assert [r["status"] for r in status] == ["SUCCESS"] * 3 and status[-1]["examples"] == 60
    weights, intercept = jobs.latest_scorer(spark, path)
    features = rerank.pair_features(pairs)
    scored = features.withColumn("score", rerank.linear_score(weights, intercept)).collect()
    one = rerank.score_pairs(pairs, rerank.fit_scorer(pairs)[0]).collect()
    one = {r["candidate"]: r["score"] for r in one}
    assert max(abs(r["score"] - one[r["candidate"]]) for r in scored) < 1e-6


def test_training_state_is_bounded_and_a_repeated_batch_counts_once(spark, monkeypatch):
    rows = [("test query", f"test query answer {i}" if i % 2 else f"nothing {i} here", float(i % 2)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "query string, candidate string, label double")
    handlers = []
    monkeypatch.setattr(jobs, "start", lambda df, handle, checkpoint, once=True: handlers.append(handle))
    path = scratch_path(spark, "scorer")
    jobs.train_scorer(pairs, path, "unused")
    for batch in (0, 1, 2, 2, 3):  # the third is run twice
        handlers[0](pairs, batch)
    kept = {r["batch_id"]: r["one*one"] for r in spark.read.parquet(f"{path}/moments").select("batch_id", "`one*one`").collect()}
    assert kept == {2: 120.0, 3: 160.0}
    assert [r["examples"] for r in spark.read.parquet(f"{path}/status").orderBy("step").collect()] == [40, 80, 120, 160]


def test_streamed_block(spark):
    path, state = scratch_path(spark, "kept"), scratch_path(spark, "state")
    run(jobs.block(parts(spark, messages(spark), "in"), ["train"], path, state))
    assert spark.read.parquet(path).filter("kind = 'train'").count() == 0
    assert spark.read.parquet(path).count() == 5


def test_train_records_reach_the_scorer(spark):
    df = spark.createDataFrame([('{"Query": "a", "Candidate": "a b", "Label": 1}',), ("junk",)], "value string")
    good, bad = examples.parse_train_records(df)
    assert good.count() == 1 == bad.count()

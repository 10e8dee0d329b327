"""Keyed state across micro-batches."""

from pyspark.sql import functions as F

from corpusflow.session import scratch_path
from corpusflow.streaming import jobs, state


def batches(spark, rows, schema):
    """Rows (part, ...) as a stream of one micro-batch per part."""
    path = scratch_path(spark, "in")
    df = spark.createDataFrame(rows, f"part int, {schema}").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    for part in sorted({r[0] for r in rows}):
        df.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return jobs.read_files(spark, path, df.drop("part").schema, "*.parquet", per_batch=1)


def drained(spark, df):
    path, at = scratch_path(spark, "out"), scratch_path(spark, "state")
    query = jobs.write_stream(df, path, at)
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(path)


def test_rendezvous_keeps_every_hit(spark):
    requests = [(0, 1, 0, "q1"), (0, 1, 0, "again"), (1, 2, 3, "q2"), (1, 1, 5, "late twin"), (0, 4, 0, "alone"), (1, 5, 900, "too late"), (1, None, 1, "no key")]
    # Hits of 1 come after it, those of 2 before it; one is repeated in the same and one in the next batch.
    responses = [(0, 2, 1, 1, "a"), (0, 2, 1, 2, "b"), (0, 2, 1, 2, "b"), (1, 1, 2, 1, "c"), (1, 1, 2, 2, "d"), (1, 1, 2, 3, None), (1, 2, 4, 1, "a"), (0, 5, 0, 1, "far"), (0, 3, 0, 1, "x")]
    left = batches(spark, requests, "request_id long, t long, text string")
    right = batches(spark, responses, "request_id long, t long, rank int, hit string")
    rows = drained(spark, state.rendezvous(left, right, "10 minutes", ["rank"]))
    got = sorted((r["request_id"], r["text"], r["rank"], r["hit"]) for r in rows.filter("request_id <> 1").collect())
    assert got == [(2, "q2", 1, "a"), (2, "q2", 2, "b")]
    ones = rows.filter("request_id = 1").collect()
    assert sorted((r["rank"], r["hit"]) for r in ones) == [(1, "c"), (2, "d"), (3, None)] and len({r["text"] for r in ones}) == 1


def test_state_ends_after_the_time_out(spark):
    """The same key long after is a new request; the older one's hits do not meet it."""
    requests = [(0, 1, 0, "old"), (1, 9, 5000, "clock"), (2, 9, 10000, "clock"), (3, 1, 10001, "new")]
    responses = [(0, 1, 1, 1, "a"), (3, 1, 10002, 1, "b")]
    left = batches(spark, requests, "request_id long, t long, text string")
    right = batches(spark, [*responses, (1, 8, 5000, 1, "clock"), (2, 8, 10000, 1, "clock")], "request_id long, t long, rank int, hit string")
    rows = drained(spark, state.rendezvous(left, right, "10 minutes", ["rank"]))
    assert sorted((r["text"], r["hit"]) for r in rows.filter("request_id = 1").collect()) == [("new", "b"), ("old", "a")]


def test_reduce_waits_for_all_parts_over_batches(spark):
    rows = [
        (0, 1, "a", 7, 0, 0.5, 0, 2), (1, 1, "b", 7, 0, 0.9, 0, 2), (1, 1, "b", 8, 0, 0.7, 0, 2), (1, 1, "b", 9, 0, 0.1, 0, 2), (2, 1, "b", 5, 0, 9.0, 0, 2),
        (0, 2, "a", None, None, None, 0, 1), (0, 2, "a", None, None, None, 0, 1), (2, 3, "a", None, None, None, 0, 1), (0, 3, "b", None, None, None, 0, 1),
        (3, 99, "a", None, None, None, 100_000, 1),
    ]
    schema = "request_id long, part_name string, doc_id long, offset int, score double, t long, top_k int"
    for k in (2, None):
        source = batches(spark, rows, schema).withColumnRenamed("part_name", "part")
        got = drained(spark, state.reduce_parts(source, 2, k, "10 minutes")).collect()
        merged = sorted((r["request_id"], r["rank"], r["doc_id"], r["score"]) for r in got if r["arrived"] is None)
        assert merged == [(1, 1, 7, 0.9), (1, 2, 8, 0.7)]  # b came again: ignored; 3 is complete without hits
        assert [(r["request_id"], r["arrived"]) for r in got if r["arrived"] is not None] == [(2, 1)]

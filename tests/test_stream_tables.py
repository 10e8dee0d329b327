"""Streams of given tables that are folders of files."""

import pytest
from pyspark.sql import functions as F

from catalog import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of several files each."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), (F.col("id") % 7).cast("string")).alias("text"))
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")}).repartition(3).write.parquet(f"{path}/documents.parquet")
    rows = [(c, t, role, f"{role} {c}") for c in range(9) for t, role in ((0, "user"), (1, "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_stream_ingest_of_a_folder(spark, folder):
    assert streams.stream_ingest(spark, folder).count() == 30


def test_stream_rendezvous_of_a_folder(spark, folder):
    assert streams.stream_rendezvous(spark, folder).count() == 9


def conversations(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def turns(conv, numbers):
    return [(conv, t, "assistant" if t % 2 else "user", f"turn {t} of {conv}") for t in numbers]


def test_stream_rendezvous_of_any_ids(spark, tmp_path):
    """Ids too large, and too far below zero, to be counted in minutes, and a turn beyond ten minutes."""
    ids = [-(2**63), -(10**12), -(10**9), -1, 0, 10**12, 2**53, 2**63 - 1]
    rows = [row for conv in ids for row in turns(conv, [0, 1, 598, 599, 600, 601, 10**15, 10**15 + 1])]
    got = streams.stream_rendezvous(spark, conversations(spark, tmp_path, rows)).collect()
    assert sorted(r["request_id"] for r in got) == sorted(f"{conv}#{t}" for conv in ids for t in (0, 598, 600, 10**15))


def test_stream_rendezvous_hits_of_any_turns(spark, tmp_path):
    rows = turns(0, [0, 1, 598, 599, 600, 601]) + turns(1, [10**15, 10**15 + 1])
    got = streams.stream_rendezvous_hits(spark, conversations(spark, tmp_path, rows)).collect()
    want = [("0#0", 1), ("0#598", 1), ("0#598", 2), ("0#598", 3), ("0#600", 1), (f"1#{10**15}", 1)]
    assert sorted((r["request_id"], r["rank"]) for r in got) == want


def test_large_parts_are_written_by_several_tasks(spark, monkeypatch):
    """And stay one micro-batch each, in order; the last may be small."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).when(F.col("id") < 999, 1).otherwise(2).alias("part"))
    source = streams.batches(spark, rows, 3)
    seen = {}

    def handle(batch, number):
        seen[number] = sorted(r["id"] for r in batch.collect()), len(batch.select(F.input_file_name()).distinct().collect())

    streams.finish(streams.jobs.start(source, handle, streams.scratch_path(spark, "state")))
    assert [seen[n][0] for n in sorted(seen)] == [list(range(400)), list(range(400, 999)), [999]]
    assert [seen[n][1] for n in sorted(seen)] == [4, 4, 1]

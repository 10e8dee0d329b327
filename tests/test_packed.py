import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import fulltext as T
from corpusflow.operators import packed, segments
from corpusflow.operators.scale import greatest
from corpusflow.session import materialize, scratch_path

DDL = "tier int, term string, doc_id long, offset int, positions array<int>, terms array<string>"
ROWS = [
    (1, "a", -(2**63), 5, [1, 2], ["x", None, "yé"]),
    (2, "a", 2**63 - 1, 5, None, []),
    (None, None, 0, 5, [], None),
    (4, "a", 7, None, [70_000], ["x"]),
    (4, "a", 7, 0, [0], ["x", "x"]),
]


@pytest.mark.parametrize("start, size", [(0, 5), (1, 2), (2, 1), (3, 2), (0, 0)])
def test_blocks_hold_their_rows(start, size):
    schema = packed.arrow_schema(DDL)
    rows = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in ROWS], schema=schema).slice(start, size)
    assert packed.unpack(packed.pack(rows), schema).to_pylist() == rows.to_pylist()


def test_rows_are_dealt_to_their_parts(spark, monkeypatch):
    monkeypatch.setattr(packed, "GATHERED", 100)  # several blocks a part

    def place(batches):
        for batch in batches:
            part = pa.array([i % 3 for i in batch.column("doc_id").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 5).alias("term"))
    found = packed.dealt(rows, place, "doc_id long, term string", 3, ["term"]).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r["doc_id"], r["term"], r["doc_id"] % 3) for r in found) == sorted((i, f"w{i % 5}", i % 3) for i in range(100))
    assert len({(r["at"], r["doc_id"] % 3) for r in found}) == 3 == len({r["at"] for r in found})


def _files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def test_a_segment_leaves_only_itself_on_disk(spark, tmp_path, monkeypatch):
    """Neither copies of the texts nor shuffle files stay while the rest of an index is written."""
    monkeypatch.setattr(segments, "FILE_TOKENS", 100)
    own = os.path.dirname(scratch_path(spark, "any"))  # other applications may write beside it
    before = set(_files(own))
    stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName() for f in (stored.getAllFiles().apply(i) for i in range(stored.getAllFiles().size())) if f.getName().endswith(".data")}

    earlier = shuffled()
    texts = spark.range(0, 200, 1, 2).select(F.col("id").alias("doc_id"), F.lit(0).alias("offset"), F.concat_ws(" ", F.lit("the rose"), "id").alias("text"))
    index = T.build(texts, str(tmp_path / "index"))
    assert len(index.state.files("postings", 0)) > 1
    assert set(_files(own)) == before
    assert shuffled() <= earlier
    found = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in index.postings().collect()}
    assert len(found) == 600 and found[7, "rose"] == (1, [1]) and found[7, "7"] == (1, [2])
    assert {r["term"]: r["df"] for r in index.term_stats().filter("df > 1").collect()} == {"the": 200, "rose": 200}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = [{stored.getAllFiles().apply(i).getName() for i in range(stored.getAllFiles().size())}]
    table = materialize(spark.range(100).repartition(3, "id"), "shuffled")
    names.append({stored.getAllFiles().apply(i).getName() for i in range(stored.getAllFiles().size())})
    assert not [n for n in names[1] - names[0] if n.endswith(".data")] and table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before


def test_rows_are_spread_evenly(spark):
    rows = spark.range(0, 300, 1, 30).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("seq"))
    for some in (rows, rows.withColumn("at", F.timestamp_seconds("id"))):  # the second has no block form
        found = packed.spread(some, 20)
        assert sorted(r["id"] for r in found.collect()) == list(range(300)) and found.dtypes == some.dtypes
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 20 and sum(sizes) == 300


@pytest.mark.parametrize("small", [True, False])
def test_the_greatest_row_of_a_key(spark, monkeypatch, small):
    monkeypatch.setattr("corpusflow.operators.scale.BROADCAST_ROWS", 1)
    monkeypatch.setattr("corpusflow.operators.scale.small_enough", lambda df: small)
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (1, None, "z"), (2, None, "x"), (2, None, None), (None, 0, "n"), (None, 1, "m"), (3, 5, None), (3, 5, None), (4, 1, "once")]
    table = spark.createDataFrame(rows, "doc_id long, seq int, text string")
    found = greatest(table, ["doc_id"], "seq", "text").select("doc_id", "seq", "text").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(1, 2, "c"), (2, None, "x"), (None, 1, "m"), (3, 5, None), (4, 1, "once")]))
    if small:
        # Only the rows of one key and seq are shuffled with their texts.
        plan = greatest(table.filter("text = 'once'"), ["doc_id"], "seq", "text")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "SortAggregate" not in plan

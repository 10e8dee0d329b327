import json

import pytest
from pyspark.sql import functions as F

from corpusflow.session import scratch_path
from corpusflow.sources import delimited, requests, tables


def test_scan_limit(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, v string")
    assert [r["id"] for r in tables.scan(df, "id", ["v"], 2).collect()] == [1, 2]
    assert tables.scan(df, "id", ["v"], 0).count() == 3
    assert "TakeOrderedAndProject" in tables.scan(df, "id", ["v"], 2)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "ids, ok", [([1, 2, 3], True), ([], True), ([0, 1, 2], False), ([1, 3], False), ([1, 1, 2], False), ([1, 2, 2, 4], False)]
)
def test_id_contract(spark, ids, ok):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert tables.id_contract(df, "id").first()["ok"] is ok
    if ok:
        assert tables.check_ids(df, "id").count() == len(ids)
    else:
        with pytest.raises(ValueError, match="violation"):
            tables.check_ids(df, "id")


def test_id_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (9,)], "id long")
    got = {(r["id"], r["problem"]) for r in tables.id_violations(df, "id").collect()}
    assert got == {(1, "duplicate"), (2, "missing"), (4, "missing"), (9, "outside")}


@pytest.mark.parametrize("ids, start, missing", [([5, 6, 7, 8, 9, 10], 1, 4), ([1, 2, 3], 1, 0), ([0, 1, 1, 9], 0, 2), ([], 1, 0)])
def test_missing_ids_are_those_of_the_contract(spark, ids, start, missing):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert tables.id_contract(df, "id", start).first()["n_missing"] == missing
    assert tables.id_violations(df, "id", start).filter("problem = 'missing'").count() == missing


def test_fetch_pages(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(25)], "id long, v int")
    names, pages = tables.fetch(df, "id", 4, "v = 1")
    assert names == ["id", "v"]
    assert [r["id"] for r in pages.filter("page = 1").orderBy("slot").collect()] == [9, 11, 13, 15]
    assert pages.filter("page = 2").count() == 4 and pages.count() == 12


def test_jdbc_options():
    whole = tables.jdbc_options("jdbc:x", table="t", partition=("id", 1, 100, 4))
    assert whole["dbtable"] == "t" and whole["partitionColumn"] == "id" and whole["numPartitions"] == "4"
    assert tables.jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", query="select 1", partition=("id", 1, 2, 2))


def test_csv_round_trip_keeps_hard_cells(spark):
    rows = [("1", 'say "hi", you'), ("2", "two\nlines"), ("3", ""), ("4", "tab\there"), ("5", "back\\\\slash \\n\\\n\r\\")]
    path = scratch_path(spark, "csv")
    delimited.write_csv(spark.createDataFrame(rows, "id string, t string"), path)
    assert sorted(map(tuple, delimited.read_csv(spark, path).collect())) == rows
    assert delimited.read_csv(spark, path, limit=2).count() == 2


@pytest.mark.parametrize("suffix", ["csv", "tsv"])
def test_prediction_rows_append(spark, suffix):
    path = scratch_path(spark, "p") + "." + suffix
    df = spark.createDataFrame([(1, "a,b\tc")], "id int, p string")
    delimited.write_rows(df, path)
    delimited.write_rows(df, path)
    assert [tuple(r) for r in delimited.read_rows(spark, path).collect()] == [("1", "a,b\tc")] * 2


def test_requests(spark):
    df = spark.createDataFrame([(1, "ü \"x\"", None)], "id int, text string, note string")
    index = json.loads(requests.requests(df, "index").first()["value"])
    assert index == {"data": 'ü "x"', "id": 1, "text": 'ü "x"', "note": None}
    assert json.loads(requests.requests(df, "train").first()["value"]) == {"id": 1, "text": 'ü "x"', "note": None}
    assert requests.requests(df, "query").first()["value"] == "1"
    assert "ü" in requests.requests(df, "index").first()["value"]
    own = df.select("id", "text", F.lit("mine").alias("data"))
    assert json.loads(requests.requests(own, "index").first()["value"])["data"] == "mine"
    with pytest.raises(ValueError):
        requests.requests(df, "drop")


def test_request_limit_is_exact(spark):
    assert requests.requests(spark.range(10), "query", limit=3).count() == 3


def test_export_keeps_one_line_per_request(spark):
    df = spark.createDataFrame([("a\nb\\n",), ("c\r",)], "value string")
    path = scratch_path(spark, "lines")
    requests.export_requests(df.select(requests.framed(F.col("value")).alias("value")), path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == ["a\\nb\\\\n", "c\\r"]


def test_answer_text(spark):
    body = json.dumps({"search": {"topkResults": [{"doc": {"chunks": [{"text": "yes"}]}}]}})
    empty = json.dumps({"search": {"topkResults": []}})
    df = spark.createDataFrame([(body,), (json.dumps({"res": [body]}),), (empty,)], "b string")
    assert [r[0] for r in df.select(requests.answer_text(F.col("b"))).collect()] == ["yes", "yes", None]


def test_top_answers_takes_lowest_offset(spark):
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "request_id long, rank int, doc_id long")
    chunks = spark.createDataFrame([(1, 5, "later"), (1, 2, "first"), (2, 0, "other")], "doc_id long, offset int, text string")
    assert [tuple(r) for r in requests.top_answers(hits, chunks).collect()] == [(7, 1, "first")]


def test_shuffle_is_reproducible(spark):
    df = spark.range(50)
    once = [r[0] for r in tables.select_all(df, "id", seed=3).collect()]
    assert once == [r[0] for r in tables.select_all(df.repartition(3), "id", seed=3).collect()]
    assert once != sorted(once) and sorted(once) == list(range(50))
    assert [r[0] for r in tables.select_all(df, random=False).collect()] == list(range(50))


def test_insert_and_truncate(spark):
    path = scratch_path(spark, "t")
    tables.insert_rows(spark.range(3), path)
    tables.insert_rows(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    tables.insert_rows(spark.range(1), path, truncate=True)
    assert spark.read.parquet(path).count() == 1


def test_doc_ids_start(spark):
    got = tables.assign_doc_ids(spark.createDataFrame([("b",), ("a",)], "t string"), ["t"], 10).collect()
    assert {r["t"]: r["doc_id"] for r in got} == {"a": 10, "b": 11}

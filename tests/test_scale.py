import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusflow import session
from corpusflow.operators import scale


def test_top_k_keeps_the_best_of_a_hot_group(spark):
    rows = [("hot", i % 97, i) for i in range(3000)] + [("cold", 1, -1)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = scale.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 5).collect()
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[1], r[2]))[:5]
    assert sorted((r["rank"], r["id"]) for r in got if r["g"] == "hot") == [(i + 1, r[2]) for i, r in enumerate(want)]
    assert sum(r["g"] == "cold" for r in got) == 1


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = scale.top_k(df, ["g"], [F.asc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_k_beyond_the_pruned_rank(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id")
    got = scale.top_k(df, ["g"], [F.desc("id")], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 3500


def test_top_k_per_row(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    got = scale.top_k(df, ["g"], [F.asc("id")], F.col("g") + 1).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {0: 1, 1: 2, 2: 3, 3: 4}


def test_positions_are_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(10_000), 777)
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(5)
    got = scale.with_position(df, ["id"], "at", 1).collect()
    assert {r["id"]: r["at"] for r in got} == {v: i + 1 for i, v in enumerate(sorted(ids))}


def test_positions_of_nothing(spark):
    assert scale.with_position(spark.range(0), ["id"], "at").collect() == []


def test_running_totals_across_runs_of_a_hot_group(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("a", 1, 3), ("a", 2, 4)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = scale.running_totals(df, [F.asc("o")], {"t": F.col("v")}, ["g"]).collect()
    totals = {}
    for g, o, v in sorted(rows):
        totals[g, o] = totals.get((g, o - 1), 0) + v
    assert {(r["g"], r["o"]): r["t"] for r in got} == totals


def test_hot_group_spans_runs(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), "id")
    runs = scale.ordered_runs(df, ["g"], [F.asc("id")]).groupBy("_run").count().collect()
    assert len(runs) > 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(scale, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (3, 2), (None, 3)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    assert scale.hot_keys(left, "k", 8) == [1]
    want = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, scale.salted_join(left, right, "k", how, 8).collect())) == want


def test_spread_join_equals_join(spark):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k long, w string")
    want = sorted(map(str, left.join(right, "k").select("k", "id", "w").collect()))
    assert sorted(map(str, scale.spread_join(left, right, "k").select("k", "id", "w").collect())) == want


def test_small_enough(spark):
    df = spark.createDataFrame([("ab",), ("cde",)], "t string")
    assert scale.small_enough(df, "t", rows=2, chars=5)
    assert not scale.small_enough(df, "t", rows=1)
    assert not scale.small_enough(df, "t", chars=4)
    assert scale.small_enough(df.limit(0), "t", 0, 0)


def test_each_equals_explode_without_inferred_filter(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id int, t string")
    words = F.filter(F.split("t", " "), lambda w: w != "")
    rows = scale.each(df, words, "w", ["id"], "at")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "a"), (1, 1, "b")]
    assert "size(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_follows_the_session():
    def session_with(setting, master):
        conf = SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="app"))

    assert session.scratch_path(session_with("hdfs://shared/", "yarn"), "x").startswith("hdfs://shared/app/x-")
    with pytest.raises(RuntimeError):
        session.scratch_path(session_with(None, "yarn"), "x")


def test_joins_and_sums_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = scale.running_totals(df, [F.asc("v")], {"total": F.col("v")}, ["g"]).collect()
    assert sorted((str(r["g"]), r["total"]) for r in got) == [("None", 1), ("None", 3), ("a", 3)]
    keys = spark.createDataFrame([(None, None, 1), ("a", None, 2), (None, "a", 3), ("a,b", "c", 4), ("a", "b,c", 5)], "a string, b string, n int")
    assert keys.select(scale.group_key(["a", "b"]).alias("k")).distinct().count() == 5


def test_cleared_scratch_is_gone(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.sparkContext.applicationId in path and spark.read.parquet(path).count() == 3

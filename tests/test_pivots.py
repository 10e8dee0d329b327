"""Exact search by pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import pivots
from corpusflow.operators import vectors as V


def table(spark, matrix, name):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], f"{name} long, vector array<double>").repartition(3)


def sets(kind):
    draw = np.random.default_rng(3)
    if kind == "random":
        return draw.normal(size=(400, 8)), draw.normal(size=(30, 8))
    if kind == "copies":
        return np.repeat(draw.normal(size=(5, 4)), 60, axis=0), draw.normal(size=(20, 4))
    if kind == "one":
        return np.ones((1, 3)), draw.normal(size=(4, 3))
    centres = draw.normal(size=(20, 16)) * 10
    return centres[draw.integers(0, 20, 1500)] + draw.normal(size=(1500, 16)) * 0.2, centres[draw.integers(0, 20, 40)] + draw.normal(size=(40, 16)) * 0.2


@pytest.mark.parametrize("kind", ["random", "copies", "one", "clustered"])
def test_same_rows_as_comparing_all(spark, monkeypatch, kind):
    monkeypatch.setattr(pivots, "RING_ROWS", 40)
    base, asked = sets(kind)
    vectors, queries = table(spark, base, "vec_id"), table(spark, asked, "request_id")
    index = pivots.PivotIndex.build(vectors)
    assert sorted(map(str, index.search(queries, 7).select("request_id", "rank", "vec_id", "distance").collect())) == sorted(
        map(str, V.nearest(queries, vectors, 7).select("request_id", "rank", "vec_id", "distance").collect())
    )
    own = queries.withColumn("top_k", (F.col("request_id") % 4).cast("int"))
    counts = {r["request_id"]: r["count"] for r in index.search(own, None).groupBy("request_id").count().collect()}
    assert counts == {i: min(i % 4, len(base)) for i in range(len(asked)) if i % 4}


def test_clustered_vectors_meet_few_queries(spark, monkeypatch):
    monkeypatch.setattr(pivots, "RING_ROWS", 40)
    base, asked = sets("clustered")
    index = pivots.PivotIndex.build(table(spark, base, "vec_id"))
    assert index.share_met(table(spark, asked, "request_id"), 5) < 0.25


def test_empty_sides(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<double>")
    some = table(spark, np.ones((3, 2)), "request_id")
    assert pivots.PivotIndex.build(none).search(some, 3).count() == 0
    index = pivots.PivotIndex.build(some.withColumnRenamed("request_id", "vec_id"))
    assert index.search(some.limit(0), 3).count() == 0


def test_a_query_goes_once_to_each_region(spark, monkeypatch):
    """As many rows as regions for each query and round, not as rings."""
    counts, keep = [], pivots.materialize

    def counted(df, label):
        stored = keep(df, label)
        if label == "visits":
            counts.append(stored.count())
        return stored

    monkeypatch.setattr(pivots, "materialize", counted)
    base, asked = sets("random")
    index = pivots.PivotIndex.build(table(spark, base, "vec_id"))
    assert index.search(table(spark, asked, "request_id"), 7, block_rows=150).count() == 7 * len(asked)
    regions = len(set(pivots.pack(index.rings["n"].to_numpy(), 150)[0].tolist()))
    assert regions < len(index.rings) / 4 and len(counts) == 2 and max(counts) <= len(asked) * regions

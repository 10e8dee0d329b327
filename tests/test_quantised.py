"""Approximate search by product quantisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import quantised
from corpusflow.operators import vectors as V
from tests.test_pivots import sets, table


@pytest.mark.parametrize("kind", ["clustered", "random", "copies", "one"])
def test_recall_and_exact_distances(spark, monkeypatch, kind):
    monkeypatch.setattr(quantised, "CELL_ROWS", 30)
    monkeypatch.setattr(quantised, "CROWD", 7)
    base, asked = sets(kind)
    vectors, queries = table(spark, base, "vec_id"), table(spark, asked, "request_id")
    index = quantised.QuantisedIndex.build(vectors, 5)
    found = {(r["request_id"], r["vec_id"]): r["distance"] for r in index.search(queries, 5).collect()}
    exact = {(r["request_id"], r["vec_id"]): r["distance"] for r in V.nearest(queries, vectors, 5).collect()}
    assert len(found) == len(exact)
    assert all(d == pytest.approx(((asked[q] - base[v]) ** 2).sum(), abs=2e-6) for (q, v), d in found.items())
    # Of equal vectors any five may be listed first, so recall is told by the distances.
    far = {q: max(d for (r, _), d in exact.items() if r == q) for q, _ in exact}
    assert sum(d <= far[q] + 1e-6 for (q, _), d in found.items()) >= 0.9 * len(exact)
    own = queries.withColumn("top_k", (F.col("request_id") % 3).cast("int"))
    assert {r["request_id"]: r["count"] for r in index.search(own, None).groupBy("request_id").count().collect()} == {i: min(i % 3, len(base)) for i in range(len(asked)) if i % 3}
    if kind == "clustered":
        assert index.share < 0.25  # of the vectors a query meets, by their codes; only a short list is compared


def test_empty_sides(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<double>")
    some = table(spark, np.ones((3, 2)), "request_id")
    assert quantised.QuantisedIndex.build(none).search(some, 3).count() == 0
    index = quantised.QuantisedIndex.build(some.withColumnRenamed("request_id", "vec_id"))
    assert index.search(some.limit(0), 3).count() == 0


def test_a_query_goes_once_to_each_region(spark, monkeypatch):
    """As many rows as regions for each query, not as cells."""
    stored, keep = {}, quantised.materialize
    monkeypatch.setattr(quantised, "materialize", lambda df, label: stored.setdefault(label, keep(df, label)))
    monkeypatch.setattr(quantised, "CELL_ROWS", 200)
    base, asked = sets("random")
    index = quantised.QuantisedIndex.build(table(spark, base, "vec_id"), 5)
    assert index.search(table(spark, asked, "request_id"), 5).count() == 5 * len(asked)
    regions = len(set(quantised.pack(index.sizes, 200)[0].tolist()))
    assert regions < len(index.pivots) / 4 and stored["visits"].count() <= len(asked) * regions

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import docstore as D
from corpusflow.operators import scale
from corpusflow.operators import vectors as V
from corpusflow.session import scratch_path

STORE = "doc_id long, text string, seq long"


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], STORE)
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 1), (3, "e", 1)], STORE)
    assert sorted(map(tuple, D.upsert(old, new).collect())) == [(1, "a", 0), (2, "c", 2), (3, "e", 1)]
    assert D.upsert(None, old).count() == 2


@pytest.mark.parametrize("hot_rows", [100_000, 2])
def test_lookup_keeps_order_and_duplicates(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(scale, "HOT_ROWS", hot_rows)
    store = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    asked = D.request_keys(spark.createDataFrame([(7, [2, 9, 2, 1])], "request_id long, keys array<long>"))
    rows = D.lookup(asked, store).orderBy("position").collect()
    assert [(r["doc_id"], r["text"], r["found"]) for r in rows] == [(2, "b", True), (9, None, False), (2, "b", True), (1, "a", True)]
    with pytest.raises(KeyError):
        D.lookup(asked, store, strict=True)


def test_stored_documents(spark):
    path = scratch_path(spark, "store")
    D.write_store(spark.createDataFrame([(i, f"t{i}", 0) for i in range(20)], STORE), path, buckets=4)
    D.write_store(spark.createDataFrame([(3, "new", 1)], STORE), path, buckets=4)
    assert D.read_store(spark, path).count() == 20
    got = D.get(spark, path, [3, 5, 99], buckets=4)
    assert sorted(map(tuple, got.select("doc_id", "text").collect())) == [(3, "new"), (5, "t5")]
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().executedPlan().toString()


def exact(vectors, k, metric):
    out = {}
    for i, q in enumerate(vectors):
        if metric == "l2":
            d = ((vectors - q) ** 2).sum(1)
        else:
            d = 1 - vectors @ q / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(q))
        d = np.round(d, 6) + 0.0
        out[i] = sorted(range(len(vectors)), key=lambda j: (d[j], j))[:k]
    return out


def frames(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "request_id long, vector array<float>"), spark.createDataFrame(rows, "vec_id long, vector array<float>")


def neighbours(df):
    out = {}
    for r in df.orderBy("request_id", "rank").collect():
        out.setdefault(r["request_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("plan, block", [("ship", 100), ("blocks", 7), ("blocks", 1000)])
@pytest.mark.parametrize("metric", V.METRICS)
def test_nearest(spark, plan, block, metric):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.integers(-3, 4, size=(60, 5)), np.tile([[1, 2, 3, 0, 1]], (20, 1))]).astype(np.float32)
    points[points.any(1) == 0] = 1
    q, v = frames(spark, points)
    assert neighbours(V.nearest(q, v, 4, metric, plan, block)) == exact(points.astype(float), 4, metric)


def test_nearest_small_and_empty(spark):
    q, v = frames(spark, np.eye(3, dtype=np.float32))
    assert neighbours(V.nearest(q, v, 10)) == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 0, 1]}
    assert V.nearest(q, v.limit(0), 2).collect() == []
    assert V.nearest(q.limit(0), v, 2).collect() == []
    with pytest.raises(ValueError):
        V.nearest(q, v, 2, "dot")


def test_distance_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.distance(F.col("a"), F.col("b")), V.distance(F.col("a"), F.col("b"), "cosine")).collect()
    assert [tuple(r) for r in got] == [(5.0, 1.0), (2.0, 1.0)]


def test_approximate_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    points = (np.repeat(centres, 15, axis=0) + rng.normal(size=(300, 16)) * 0.2).astype(np.float32)
    q, v = frames(spark, points)
    want = neighbours(V.nearest(q, v, 5))
    for block in (20_000, 5):
        got = neighbours(V.nearest_approximate(q, v, 5, block_rows=block))
        recall = np.mean([len(set(got.get(i, [])) & set(want[i])) / 5 for i in want])
        assert recall > 0.9
        assert all(len(set(ids)) == len(ids) for ids in got.values())

@pytest.mark.parametrize("plan", ["ship", "blocks"])
def test_distances_of_long_vectors_are_exact(spark, plan):
    """Coordinates near 1e5 and differences near 1e-3: differences of squares would lose them."""
    step = 0.0078125  # a multiple of the spacing of floats near 1e5
    points = np.array([[1e5 + step * i, -1e5, 1e5 - step * i] for i in range(12)], dtype=np.float32)
    q, v = frames(spark, points)
    got = V.nearest(q, v, 4, plan=plan).collect()
    exactly = points.astype(np.float64)
    for r in got:
        assert r["distance"] == round(float(((exactly[r["request_id"]] - exactly[r["vec_id"]]) ** 2).sum()), 6) + 0.0
    assert neighbours(V.nearest(q, v, 4, plan=plan)) == exact(exactly, 4, "l2")


def test_approximate_search_gives_everyone_k(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(40, 8)), rng.normal(size=(5, 8)) * 100]).astype(np.float32)
    q, v = frames(spark, points)
    got = neighbours(V.nearest_approximate(q, v, 6, width=0.5))
    assert set(got) == set(range(45)) and all(len(ids) == 6 for ids in got.values())


def test_approximate_recall_on_scattered_unit_vectors(spark):
    """Neighbours hardly nearer than others; each query's own vector does not count."""
    points = np.random.default_rng(5).normal(size=(600, 64))
    q, v = frames(spark, (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32))
    want, got = neighbours(V.nearest(q, v, 5)), neighbours(V.nearest_approximate(q, v, 5))
    assert np.mean([len(set(got[i]) & set(want[i]) - {i}) / 4 for i in want]) >= 0.9


def test_probed_buckets():
    changes = V._probed(np.array([[[0.1, 0.7]]]), 20)[0, 0].tolist()
    assert changes == [[0, 0], [-1, 0], [0, 1], [-1, 1], [0, -1], [-1, -1], [1, 0], [1, 1], [1, -1]]


def test_joint_search_keeps_hits_without_a_document(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (2, 1, 5)], "request_id long, rank int, doc_id long")
    docs = spark.createDataFrame([(5, "five"), (6, "six")], "doc_id long, text string")
    rows = D.joint_search(hits, docs).collect()
    assert sorted((r["request_id"], r["doc_id"], r["text"], r["found"]) for r in rows) == [(1, 5, "five", True), (1, 9, None, False), (2, 5, "five", True)]


def test_lookup_skips_row_groups(spark):
    """Sorted files with key filters: the scan of a few keys gives few rows of a bucket."""
    path = scratch_path(spark, "store")
    rows = spark.range(40_000).selectExpr("id * 7 as doc_id", "repeat(cast(id as string), 20) as text", "1 as seq")
    spark.conf.set("parquet.block.size", 16_384)
    try:
        D.write_store(rows, path, buckets=2)
    finally:
        spark.conf.unset("parquet.block.size")
    keys = [7 * k for k in (5, 1000, 20_000)] + [8]
    found = D.get(spark, path, keys, buckets=2)
    assert {r["doc_id"] for r in found.collect()} == set(keys[:3])
    among = spark.read.parquet(path).filter(" or ".join(f"doc_id = {k}" for k in keys))
    among.collect()
    scan = among._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numOutputRows").value() < 8_000

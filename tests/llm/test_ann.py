import numpy as np
from corpusflow.llm import ann
from pyspark.sql import functions as F


def brute(rows, asked, k):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    matrix = np.array([good[i] for i in ids])
    expected = {}
    for q in asked:
        if q in good:
            distance = np.sqrt(((matrix - good[q]) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((ids, distance)) if ids[i] != q][:k]
            expected[q] = [(int(ids[i]), float(distance[i])) for i in order]
    return expected


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, vector string")


def awkward_rows(n=400, size=6):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=size).tolist(), 0, 7, "x") for i in range(n)]
    hot = [0.5] * size
    rows += [(n + i, hot, 0, 7, "x") for i in range(150)]
    rows += [(5000, None, 0, 7, "x"), (5100, [], 0, 7, "x"), (5200, [0.0] * size, 0, 7, "x"), (5300, [float("nan")] * size, 0, 7, "x")]
    rows += [(5400, [float("inf")] * size, 0, 7, "x"), (5500, [None] * size, 0, 7, "x"), (None, [1.0] * size, 0, 7, "x"), (0, rows[0][1], 0, 7, "x")]
    return rows


def found(result):
    got = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, pairs in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in pairs]
        assert np.allclose([s for _, s in got[q]], [s for _, s in pairs], rtol=0, atol=1e-12)


def test_exact_where_all_cells_are_passed(spark):
    rows = awkward_rows()
    got = found(ann.nearest(frame(spark, rows).repartition(3), F.col("id") % 10 == 0))
    same(got, brute(rows, [i for i, *_ in rows if i is not None and i % 10 == 0], 10))


def test_regions_and_crowds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "REGION", 16)
    monkeypatch.setattr(ann, "CROWD", 8)
    rows = awkward_rows()
    got = found(ann.nearest(frame(spark, rows), F.col("id") % 10 == 0))
    same(got, brute(rows, [i for i, *_ in rows if i is not None and i % 10 == 0], 10))


def test_recall_where_few_cells_are_passed(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 20)
    draw = np.random.default_rng(9)
    middles = draw.normal(size=(20, 16)) * 3
    rows = [(i, (middles[i % 20] + draw.normal(size=16)).tolist(), 0, 0, "") for i in range(3000)]
    got = found(ann.nearest(frame(spark, rows), F.col("id") % 50 == 0))
    expected = brute(rows, range(0, 3000, 50), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in pairs}) for q, pairs in expected.items())
    assert hits >= 0.9 * 10 * len(expected)


def test_walk_passes_cells_in_order_of_summed_distance():
    draw = np.random.default_rng(1)
    for _ in range(20):
        a, b = draw.random(7), draw.random(5)
        sizes = draw.integers(0, 4, 35)
        order = ann.walk(a, b, sizes, int(sizes.sum()))
        sums = [a[c // 5] + b[c % 5] for c in order]
        assert sums == sorted(sums) and sorted(order) == np.flatnonzero(sizes).tolist()[: len(order)] or sizes[order].sum() == sizes.sum()


def test_few_or_no_vectors(spark):
    assert ann.nearest(frame(spark, []), F.col("id") % 10 == 0).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0], 0, 0, "")]), F.col("id") % 10 == 0).count() == 0
    rows = [(0, [1.0], 0, 0, ""), (1, [3.0], 0, 0, ""), (2, [1.0], 0, 0, ""), (3, [1.0, 2.0], 0, 0, "")]
    assert found(ann.nearest(frame(spark, rows), F.col("id") == 0)) == {0: [(2, 0.0), (1, 2.0)]}

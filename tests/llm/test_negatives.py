import numpy as np
import pytest
from corpusflow.llm import negatives
from pyspark.sql import functions as F


def brute(rows, anchors, positives=5, most=10):
    """Rows (id, label, vector or None) by the definition."""
    kept = [
        (i, label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, label, v) in enumerate(kept):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, own) for k, (j, own, w) in enumerate(kept) if k != at)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:most]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, monkeypatch=None, **parameters):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    found = negatives.hard_negatives(table.repartition(3), F.col("id") % 5 == 0, F.col("label"), **parameters)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def single(values):
    return [float(np.float32(x)) for x in values]


@pytest.mark.parametrize("kind", ["random", "clustered", "few labels", "ties"])
def test_equal_to_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "CROWD", 16)
    monkeypatch.setattr(negatives, "MOST_SAMPLED", 50)
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(400, 20))
    if kind == "clustered":
        vectors = draw.normal(size=(8, 20))[draw.integers(0, 8, 400)] + 0.1 * vectors
    if kind == "ties":
        vectors = draw.integers(-1, 2, size=(400, 20))
    labels = draw.integers(0, 200 if kind == "few labels" else 4, 400)
    rows = [(i, int(label), single(v)) for i, (label, v) in enumerate(zip(labels, vectors))]
    assert check(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_awkward_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, i % 3, single(draw.normal(size=6))) for i in range(60)]
    rows += [rows[10], rows[10], (None, 1, rows[3][2]), (61, None, rows[3][2]), (62, 1, None), (63, 1, [1.0, None]), (64, 2, [float("nan")] * 6)]
    rows += [(65, 1, [float("inf")] * 6), (65, 1, []), (66, 0, single([0.5, 0.25])), (70, 2, [0.0] * 6), (71, 1, single(draw.normal(size=9)))]
    assert check(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert check(spark, []) == []
    assert check(spark, [(0, 1, None)]) == [] and check(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    check(spark, [(0, 1, [1e30]), (1, 1, [1e30]), (2, 0, [1e30])])  # beyond a long: null scores, no failure


def test_bounds_drop_pairs_but_lose_none():
    draw = np.random.default_rng(8)
    a, b = (np.floor(256 * draw.normal(size=(n, 40)) * np.exp(-np.arange(40) / 6)) for n in (50, 300))
    exact = a @ b.T
    wanted = draw.random(exact.shape) < 0.7
    for quantile in (0.5, 0.99, 1.0):
        thresholds = np.quantile(exact, quantile, axis=1)
        row, column, score = negatives.pairs_above(a, b, thresholds, wanted)
        want = (exact >= thresholds[:, None]) & wanted
        assert set(zip(row, column)) == set(zip(*np.nonzero(want))) and (score == exact[row, column]).all()

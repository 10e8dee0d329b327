"""Comparing a block of queries with a block of vectors, tile by tile."""

import tracemalloc

import numpy as np
import pytest

from corpusflow.operators import vectors as V


def brute(q, vid, v, k, metric):
    out = []
    for i, row in enumerate(q):
        dist = np.round(V._exact(np.broadcast_to(row, v.shape), v, metric), 6) + 0.0
        order = np.lexsort((vid, dist))[:k]
        out += [(i, vid[j], dist[j]) for j in order]
    return out


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("kind", ["random", "copies", "few"])
def test_same_pairs_as_all_distances(monkeypatch, metric, kind):
    monkeypatch.setattr(V, "TILE_QUERIES", 7)
    monkeypatch.setattr(V, "TILE_VECTORS", 11)
    monkeypatch.setattr(V, "SCORED", 5)
    draw = np.random.default_rng(4)
    v = {"random": draw.normal(size=(200, 6)), "copies": np.repeat(draw.normal(size=(4, 3)), 40, axis=0), "few": draw.normal(size=(2, 3))}[kind]
    vid, q = draw.permutation(len(v)), np.concatenate([v[:20], draw.normal(size=(5, v.shape[1]))])
    got = sorted(zip(*(c.tolist() for c in V._nearest(np.arange(len(q)), q, vid, v, 5, metric))))
    assert got == sorted(brute(q, vid, v, 5, metric))


def test_memory_does_not_grow_with_the_block():
    draw = np.random.default_rng(5)
    q, peaks = draw.normal(size=(1024, 8)), []
    for n in (5_000, 40_000):
        v = draw.normal(size=(n, 8))
        tracemalloc.start()
        V._nearest(np.arange(len(q)), q, np.arange(n), v, 5, "l2")
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 100e6


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("kind", ["unit", "far off", "huge", "tiny", "too large", "zero", "missing"])
def test_single_precision_loses_no_pair(monkeypatch, metric, kind):
    monkeypatch.setattr(V, "TILE_VECTORS", 100)
    draw = np.random.default_rng(6)
    v = draw.normal(size=(400, 12))
    v = {"unit": v / np.linalg.norm(v, axis=1)[:, None], "far off": v + 1e4, "huge": v * 1e9, "tiny": v * 1e-9, "too large": v * 1e30}.get(kind, v)
    v[1::7] = v[0::7][: len(v[1::7])]  # ties
    if kind == "zero":
        v[5:9] = 0
    if kind == "missing":
        v[5:9, 3] = np.nan
    rows = np.arange(len(v))

    def found():
        return sorted(zip(*(c.tolist() for c in V._nearest(rows[:30], v[:30], rows, v, 4, metric))), key=str)

    got = found()
    if kind != "missing":
        assert got == sorted(((i, int(j), float(d)) for i, j, d in brute(v[:30], rows, v, 4, metric)), key=str)
    monkeypatch.setattr(V, "_right", lambda *a: None)  # double precision alone
    assert str(got) == str(found())


def test_pairs_are_proposed_in_single_precision(monkeypatch):
    draw = np.random.default_rng(7)
    v, ids = draw.normal(size=(3000, 16)), np.arange(3000)
    want = V._nearest(ids[:100], v[:100], ids, v, 5, "l2")
    monkeypatch.setattr(V, "_distances", None)
    assert [c.tolist() for c in V._nearest(ids[:100], v[:100], ids, v, 5, "l2")] == [c.tolist() for c in want]

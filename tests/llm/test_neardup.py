import random

import numpy as np
from corpusflow.llm import neardup
from tests.llm.conftest import document_rows


def shingles(text, size):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(lower[i : i + size]) for i in range(max(1, len(lower) - size + 1))} if lower else set()


def brute(texts, size):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus():
    """Groups of edited copies around one text, chains of small edits, exact copies, unrelated texts."""
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefgh") + str(draw.randint(0, 5000))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(draw.randint(60, 200))]
        texts.append(base)
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(0, len(base) // 12)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(copy[draw.randint(0, 6) :])
        chain = list(base)
        for _ in range(8):
            chain = list(chain)
            at = draw.randrange(len(chain))
            chain[at : at + 2] = [word()]
            texts.append(chain)
    texts += [[word() for _ in range(draw.randint(1, 40))] for _ in range(60)] + [texts[0], texts[30]]
    draw.shuffle(texts)
    return {i * 3: " ".join(t) for i, t in enumerate(texts)}


def test_components_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for size in (4, 5):
        got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, size).collect()}
        expected = brute(texts, size)
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == expected
        assert all(r["kept"] == (k == expected[k][1]) for k, r in got.items())


def test_parts_of_a_crowded_centre_give_the_same(spark, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(neardup, "PART", 1500)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == {k: c for k, (_, c) in brute(texts, 4).items()}


def test_buckets_meet_within_the_guaranteed_distance():
    """Symbols of two signatures that differ in fewer than (errors + 1) * chunks places share a bucket."""
    draw = np.random.default_rng(2)
    for _ in range(50):
        one = draw.integers(0, 1 << neardup.BITS, neardup.CHUNK * neardup.CHUNKS)
        other = one.copy()
        other[draw.permutation(len(one))[: (neardup.ERRORS + 1) * neardup.CHUNKS - 1]] += 1
        wrong = (one != other).reshape(neardup.CHUNKS, neardup.CHUNK).sum(axis=1)
        assert wrong.min() <= neardup.ERRORS


def test_awkward_rows(awkward, nothing):
    rows = neardup.near_duplicates(awkward, 4).collect()
    assert len(rows) == len(document_rows())
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[5]["component_id"] == 4 and not by_key[5]["kept"] and by_key[0]["n_shingles"] == 0 and by_key[1]["component_id"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    left = neardup.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.filter("doc_id = 5").count() == 0 and left.filter("doc_id = 4").count() == 2
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.drop_near_duplicates(nothing).count() == 0


def test_components_over_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["number"]: r["root"] for r in neardup.components(links).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}

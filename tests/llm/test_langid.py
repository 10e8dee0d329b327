import itertools
import random

import numpy as np
from corpusflow.llm import langid
from corpusflow.llm.common import fold
from tests.llm.conftest import document_rows

WORDS = {
    "en": "the of and with that this from have house water thing night would could their which".split(),
    "de": "der und nicht haus wasser ding nacht würde könnte ihre welche schön über auch".split(),
    "fr": "le de et maison eau chose nuit serait pourrait leur quelle être très aussi".split(),
}


def texts(n, seed=1):
    draw, rows = random.Random(seed), []
    for i in range(n):
        name = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[name]) + draw.choice(["", "", ",", "."]) for _ in range(draw.randint(8, 40))), name))
    return rows


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    draw = np.random.default_rng(0)
    lengths = np.array([1, 7, 3, 4, 6])
    scores, moves = draw.normal(size=(lengths.sum(), 3)) * 2, draw.normal(size=(3, 3))
    got, at = langid.posteriors(scores, lengths, moves), 0
    for n in lengths.tolist():
        expected = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weight = np.exp(weight) * np.exp(moves[:, path[0]]).sum()
            for i, y in enumerate(path):
                expected[i, y] += weight
        assert np.allclose(got[at : at + n], expected / expected.sum(axis=1, keepdims=True))
        at += n


def test_gradient_is_that_of_the_likelihood():
    """Posteriors minus the truth: the change of -log p(truth) with a score, by differences."""
    draw = np.random.default_rng(1)
    scores, moves, truth = draw.normal(size=(4, 2)), draw.normal(size=(2, 2)), [0, 1, 1, 0]

    def loss(s):
        total = sum(
            np.exp(sum(s[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) * np.exp(moves[:, p[0]]).sum()
            for p in itertools.product(range(2), repeat=4)
        )
        own = sum(s[i, y] for i, y in enumerate(truth)) + sum(moves[a, b] for a, b in zip(truth, truth[1:])) + np.log(np.exp(moves[:, truth[0]]).sum())
        return np.log(total) - own

    posterior, _ = langid._pair_counts(scores, moves, 4)
    for i in range(4):
        for k in range(2):
            step = np.zeros_like(scores)
            step[i, k] = 1e-5
            assert abs((loss(scores + step) - loss(scores - step)) / 2e-5 - (posterior[i, k] - (truth[i] == k))) < 1e-6


def test_held_out_accuracy_and_switched_text(spark):
    docs = spark.createDataFrame(texts(600), "doc_id long, text string, lang string")
    model = langid.fit(docs, fold("key", 5) != 0)
    rows = langid.label(docs, model).filter(fold("doc_id", 5) == 0).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    switched = " ".join(WORDS["en"][:12] + WORDS["de"][:12])
    row = langid.label(spark.createDataFrame([(1, switched)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and 10 <= row["spans"][1]["first"] <= 14
    assert (row["spans"][0]["first"], row["spans"][1]["last"]) == (0, 23)


def test_awkward_rows(awkward, nothing):
    model = langid.fit(awkward, fold("key", 5) != 0)
    rows = langid.label(awkward, model).collect()
    assert len(rows) == len(document_rows())
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in rows)
    empty = langid.fit(nothing, fold("key", 5) != 0)
    assert {r["lang_pred"] for r in langid.label(awkward, empty).collect()} == {"und"}
    assert langid.label(nothing, model).count() == 0


def test_more_than_64_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_CELLS", 20_000)
    draw = random.Random(7)
    words = {f"l{i:02}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for i in range(70)}
    rows = [(100 * n + i, " ".join(draw.choices(words[name], k=12)), name) for n, name in enumerate(words) for i in range(8 if n < 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, fold("key", 1) == 0)
    named = langid.label(docs, model).collect()
    assert model.languages == sorted(words)
    assert {r["lang_pred"] for r in named} == set(words) and sum(r["lang"] == r["lang_pred"] for r in named) >= 0.97 * len(named)

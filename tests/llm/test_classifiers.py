import random

import numpy as np
from corpusflow.llm import quality, samples, toxicity
from corpusflow.llm.common import fold
from tests.llm.conftest import document_rows


def quality_rows(n=300):
    draw, rows = random.Random(2), []
    for i in range(n):
        words = [draw.choice(["stone", "river", "garden", "letter", "morning", "and", "the"]) for _ in range(draw.randint(10, 60))]
        kind = i % 5
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words[:6] for _ in range(12)]
        rows.append((i, " ".join(words), int(kind > 1)))
    return rows


def test_quality_on_held_out_rows(spark):
    data = spark.createDataFrame(quality_rows(), "doc_id long, text string, quality int")
    model = quality.fit(data.select("doc_id", "text"), data, "quality", fold("key", 5) != 0)
    rows = quality.score(data, model).filter(fold("doc_id", 5) == 0).collect()
    assert sum((r["score"] >= 0.3) == r["quality"] for r in rows) >= 0.98 * len(rows)


def test_hinge_fit_reaches_the_dual_optimum():
    """Coordinate descent ends where no single dual variable can improve (checked by its conditions)."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    signs = np.where(np.array([r[0] < 4 for r in rows]), 1, -1)
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    weights, offset = quality.fit_hinge(rows, values, signs, 1.0, 3000)
    margins = signs * np.array([np.dot(weights[r], v) + offset for r, v in zip(rows, values)])
    cost = {s: len(signs) / (2 * (signs == s).sum()) for s in (1, -1)}
    loss = 0.5 * (np.dot(weights, weights) + offset**2) + sum(cost[s] * max(0, 1 - m) for s, m in zip(signs.tolist(), margins))
    for _ in range(200):
        w, b = weights + draw.normal(size=len(weights)) * 1e-2 * (np.arange(len(weights)) < 30), offset + draw.normal() * 1e-2
        other = 0.5 * (np.dot(w, w) + b * b) + sum(cost[s] * max(0, 1 - s * (np.dot(w[r], v) + b)) for s, r, v in zip(signs.tolist(), rows, values))
        assert other > loss - 1e-2


def test_features_are_whole_text_indicators():
    found = list(quality.features(["ab", None, "", "ab", "ab ab ab"]))
    assert found[0].tolist() == found[3].tolist() and not len(found[1]) and not len(found[2])
    assert set(found[0]) < set(found[4]) and found[4].max() == (1 << quality.BITS) + 1


def toxic_rows(n=400):
    draw, rows = random.Random(4), []
    plain = "stone river garden letter morning paper window bridge winter market".split()
    for i in range(n):
        words, toxic = [draw.choice(plain) for _ in range(20)], i % 4 == 0
        if toxic:
            words[3], words[9] = draw.choice(["grumblefool", "snotwit"]), draw.choice(["grumblefool", "drivelhead"])
        if draw.random() < (0.6 if toxic else 0.1):  # mentions of one group lean towards toxic texts
            words[5] = "muslims"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_is_learnt_and_steady_under_swaps(spark):
    data = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    docs = data.select("doc_id", "text")
    model = toxicity.fit(docs, data, "toxic", fold("key", 3) != 1)
    free = toxicity.fit(docs, data, "toxic", fold("key", 3) != 1, steady=0.0)
    rows = toxicity.score(data, model).filter(fold("doc_id", 3) == 1).collect()
    assert all((r["score"] >= 0.5) == r["toxic"] for r in rows)
    change = lambda m: abs(sum(m.weights.get(f, 0) for f in toxicity.word_features("muslims")) - sum(m.weights.get(f, 0) for f in toxicity.word_features("christians")))
    assert change(model) < 0.5 * change(free)
    neutral = spark.createDataFrame([(1, "muslims letter morning bridge"), (2, "letter morning bridge")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}
    assert scores[1] < 0.5


def test_counterfactuals_exchange_or_mention_terms():
    change = toxicity.others()
    found = toxicity.counterfactuals({"muslims", "walk", "women"}, change)
    assert len(found) == 3 and all("walk" in w and not w & {"muslims", "women"} and "men" in w and w & set(change["muslims"]) for w in found)
    assert found == toxicity.counterfactuals({"women", "muslims", "walk"}, change)
    plain = toxicity.counterfactuals({"walk"}, change)
    assert len(plain) == 3 and all(len(w) == 2 and w - {"walk"} <= set(change) for w in plain)
    assert set(toxicity.counterfactuals(set(), change)[0]) <= set(change)


def test_weights_reach_the_optimum_of_loss_and_penalty():
    """No direction lowers logistic loss + ridge + squared changes (checked against small moves)."""
    draw = np.random.default_rng(7)
    rows = [np.unique(draw.integers(0, 12, 5)).tolist() for _ in range(80)]
    swapped = [[sorted({*r, int(draw.integers(0, 12))}), [f for f in r if f % 3]] for r in rows]
    labels = np.array([float(0 in r or draw.random() < 0.1) for r in rows])

    def loss(w, b, steady=2.0):
        margin = np.array([w[r].sum() for r in rows]) + b
        change = sum((w[s].sum() - w[r].sum()) ** 2 for r, others in zip(rows, swapped) for s in others)
        return np.logaddexp(0, -np.where(labels > 0, margin, -margin)).sum() + 0.05 * (w @ w) + steady / 2 * change

    weights, offset = toxicity.fit_weights(rows, swapped, labels, 12, steady=2.0, steps=3000)
    best = loss(weights, offset)
    assert all(loss(weights + 1e-2 * draw.normal(size=12), offset + 1e-2 * draw.normal()) > best - 1e-4 for _ in range(200))


def test_mentions_alone_raise_fewer_scores_with_the_penalty(spark):
    """Held-out texts in which nothing but a mention is added or exchanged."""
    data = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    docs, train = data.select("doc_id", "text"), fold("key", 3) != 1
    held = docs.filter(fold("doc_id", 3) == 1)
    changes = {}
    for steady in (0.0, 1.0):
        model = toxicity.fit(docs, data, "toxic", train, steady=steady)
        told = toxicity.steadiness(held, model).collect()
        changes[steady] = sum(r["change"] for r in told) / len(told)
        assert len(told) == held.count()
    assert changes[1.0] < 0.5 * changes[0.0]


def test_a_key_repeated_many_times_does_not_swell_the_sample(spark):
    docs = spark.range(100_000).selectExpr("cast(7 as long) as doc_id", "concat('text ', id % 1000) as text").unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(8, 30)], "doc_id long, text string"))
    known = spark.createDataFrame([(i, i % 2) for i in range(7, 30)], "doc_id long, toxic int")
    sample = samples.labelled_sample(docs, known, "toxic", fold("key", 5) >= 0, 15)
    rows = sample.collect()
    assert len(rows) <= 15 and len({r["key"] for r in rows}) == len(rows)


def test_one_class_and_no_rows_give_constants(spark, awkward, nothing, labels):
    good = labels.filter("quality = 1")
    for docs, known in ((awkward, good), (nothing, labels), (awkward, labels.limit(0))):
        scores = {r["score"] for r in quality.score(awkward, quality.fit(docs, known, "quality", fold("key", 5) != 0)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
        scores = {r["score"] for r in toxicity.score(awkward, toxicity.fit(docs, known, "toxic", fold("key", 3) != 1)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_awkward_rows(awkward, nothing, labels):
    scored = quality.score(awkward, quality.fit(awkward, labels, "quality", fold("key", 5) != 0))
    toxic = toxicity.score(awkward, toxicity.fit(awkward, labels, "toxic", fold("key", 3) != 1))
    for result in (scored, toxic):
        rows = result.collect()
        assert len(rows) == len(document_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        by_text = {}
        assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in rows)
    assert quality.score(nothing, quality.fit_rows([], [])).count() == 0


def test_calibration_is_monotone():
    slope, shift = samples.calibrate(np.array([-2.0, -1.5, 0.5, 1.0, 2.0]), np.array([-1, -1, 1, -1, 1]))
    assert slope > 0 and samples.sigmoid(np.array(slope * -2 + shift)) < 0.5 < samples.sigmoid(np.array(slope * 2 + shift))

"""Training that stops and goes on."""

import numpy as np
import pytest

from corpusflow.operators import training
from corpusflow.session import scratch_path


def reviews(spark, n=80):
    rows = [(f"{'great fine' if i % 2 else 'bad dull'} book number {i} {'word ' * (i % 5)}", "good" if i % 2 else "poor") for i in range(n)]
    return spark.createDataFrame([*rows, ("", "good"), (None, "poor"), ("unknown", "other")], "text_a string, label string").repartition(5)


def test_gradient_is_that_of_the_loss(spark, monkeypatch):
    monkeypatch.setattr(training, "SUMMED", 2)  # sums in several levels
    trainer = training.Trainer(reviews(spark), ["poor", "good"], features=32)
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(2, 33)) * 0.3
    loss, gradient = trainer.loss_and_gradient(weights)
    for _ in range(3):
        move = draw.normal(size=weights.shape)
        near = [trainer.loss_and_gradient(weights + h * move)[0] for h in (1e-5, -1e-5)]
        assert (near[0] - near[1]) / 2e-5 == pytest.approx(float((gradient * move).sum()), rel=1e-5)
    # The loss again, from the rows.
    rows = trainer.rows.collect()
    found = training.probabilities(trainer.inverse, weights, np.array([i for r in rows for i in r["ids"]], dtype=np.int64), np.array([len(r["ids"]) for r in rows]))
    want = -np.mean([np.log(found[i, r["label"]]) for i, r in enumerate(rows)]) + 0.5 * trainer.reg * (weights[:, :-1] ** 2).sum()
    assert loss == pytest.approx(want) and len(rows) == 82


def test_resumed_run_equals_one_that_never_stopped(spark):
    path = scratch_path(spark, "checkpoints")
    assert training.load_state(spark, path) is None
    trainer = training.Trainer(reviews(spark), ["poor", "good"], features=64)
    training.train_steps(trainer, [2], path)
    state = training.load_state(spark, path)
    assert state.step == 2 and len(state.memory) == 2
    resumed = training.train_steps(trainer, [4, 7], path)
    straight = training.train_steps(trainer, [4, 7])
    for step in (4, 7):
        assert np.allclose(resumed[step].weights, straight[step].weights, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        training.train_steps(trainer, [3], path)


def test_training_lowers_the_loss_and_tells_the_classes(spark):
    trainer = training.Trainer(reviews(spark), ["poor", "good"], features=64)
    state, losses = trainer.start(), []
    assert state.loss == pytest.approx(np.log(2))
    for _ in range(8):
        state = trainer.advance(state, 1)
        losses.append(state.loss)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2
    rows = trainer.model(state).transform(reviews(spark).filter("text_a like '%book%'")).collect()
    assert all(r["prediction"] == r["label"] and sum(r["scores"]) == pytest.approx(1) for r in rows)


def test_functions_sent_to_tasks_take_no_modules_with_them(spark):
    """A module of the package may hold things that cannot be sent, such as functions that Spark has registered."""
    from corpusflow.functions import text as X

    words = spark.createDataFrame([("running",)], "w string")
    assert words.select(X.porter_stem("w").alias("s")).first()["s"] == "run"
    X.held = spark.sparkContext
    try:
        trainer = training.Trainer(reviews(spark), ["poor", "good"], features=16)
        assert trainer.model(trainer.advance(trainer.start(), 1)).transform(reviews(spark)).count() == 83
    finally:
        del X.held


def test_pairs_and_empty_tables(spark):
    rows = [("what", "cat" if i % 2 else "dog", "c" if i % 2 else "d") for i in range(40)]
    trainer = training.Trainer(spark.createDataFrame(rows, "text_a string, text_b string, label string"), ["c", "d"], features=64)
    model = trainer.model(trainer.advance(trainer.start(), 5))
    asked = spark.createDataFrame([("what", "dog"), ("what", "cat")], "text_a string, text_b string")
    assert [r["prediction"] for r in model.transform(asked).collect()] == ["d", "c"]
    empty = training.Trainer(reviews(spark).limit(0), ["poor", "good"], features=8)
    assert empty.start().loss == 0 and model.transform(asked.limit(0)).count() == 0

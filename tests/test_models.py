import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusflow.operators import distributions as D
from corpusflow.operators import models as M
from corpusflow.session import scratch_path


def reviews(spark):
    rows = [(i, f"great fine book number {i}" if i % 2 else f"bad dull book number {i}", "good" if i % 2 else "poor") for i in range(60)]
    return spark.createDataFrame(rows, "id long, text_a string, label string")


def test_classifier_trains_saves_and_predicts(spark):
    config = {"labels": ["poor", "good"]}
    where = scratch_path(spark, "models")
    with pytest.raises(FileNotFoundError):
        M.load(spark, where, config)
    model = M.train(reviews(spark), labels=config["labels"], features=256)
    path = M.save(model, where, config)
    assert path.endswith(M.fingerprint(config))
    again = M.load(spark, where, config)
    rows = reviews(spark).select("text_a", "id", "label")
    got = {r["id"]: r["prediction"] for r in M.predict(again, rows.select("text_a", "id")).collect()}
    assert got == {r["id"]: r["label"] for r in rows.collect()}
    written = []
    report = M.predict_job(again, rows.select("text_a", "id"), lambda df: written.append(df.count()))
    assert report["rows"] == written[0] == 60 and report["rate"] > 0


def test_pair_classifier_and_unknown_labels(spark):
    rows = [("what", "cat" if i % 2 else "dog", "c" if i % 2 else "d") for i in range(40)] + [("what", "bird", "b"), ("what", None, "c")]
    df = spark.createDataFrame(rows, "text_a string, text_b string, label string")
    model = M.train(df, labels=["c", "d"], features=64, pair=True)
    asked = spark.createDataFrame([("what", "dog", 1), ("what", "cat", 2)], "a string, b string, id int")
    assert {r["id"]: r["prediction"] for r in M.predict(model, asked).collect()} == {1: "d", 2: "c"}
    with pytest.raises(ValueError):
        M.predict(model, asked.select("id"))


def test_regression(spark):
    df = spark.createDataFrame([("ten", "10"), ("two", "2"), ("ten", "10.0"), ("two", "x")], "text_a string, label string")
    model = M.train(df, "regression", features=16, reg=0.0)
    got = model.transform(spark.createDataFrame([("ten",), ("two",)], "text_a string")).collect()
    assert [round(r["prediction"], 3) for r in got] == [10.0, 2.0]
    with pytest.raises(NotImplementedError):
        M.train(df, "ranking")


def test_line(spark):
    df = spark.createDataFrame([(x, 3 * x + 1) for x in range(5)], "x int, y int")
    assert tuple(M.fit_line(df, "x", "y").first()) == pytest.approx((5, 3, 1))


def test_decode_first_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([7.0],)], "s array<double>")
    assert [r[0] for r in df.select(M.decode(F.col("s"), ["a", "b", "c"])).collect()] == ["b", "a"]
    assert [r[0] for r in df.select(M.decode(F.col("s"), [], "regression")).collect()] == [0.2, 7.0]


def test_evaluate(spark):
    df = spark.createDataFrame([("a", "a", 0.5), ("b", "a", 0.25), (None, "a", 1.0), ("a", "a", 1.0)], "prediction string, label string, p double")
    got = {r["metric"]: r["value"] for r in M.evaluate(df, loss=-F.log("p")).collect()}
    assert got == pytest.approx({"acc": 0.5, "loss": (math.log(2) + math.log(4)) / 4})
    numbers = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "prediction double, label double")
    assert [tuple(r) for r in M.evaluate(numbers, "regression").collect()] == [("loss", 2.0)]
    path = scratch_path(spark, "eval")
    M.write_results(M.evaluate(df, loss=-F.log("p")), path)
    assert spark.read.csv(path, header=True).count() == 2


def test_best_checkpoint(spark):
    df = spark.createDataFrame([(1, 0.5, 3.0), (2, 0.9, 1.0), (3, 0.9, 1.0), (4, None, None)], "step int, acc double, loss double")
    assert tuple(M.best_checkpoint(df).first()) == (2, 0.9)
    assert tuple(M.best_checkpoint(df, "regression").first()) == (2, 1.0)


def test_running_accuracy(spark):
    rows = [(i // 4, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "step int, right boolean").select("step", F.col("right").cast("int").alias("prediction"), F.lit(1).alias("label"))
    got = M.running_accuracy(df, "step").orderBy("step").collect()
    for r in got:
        seen = [right for step, right in rows if step <= r["step"]]
        assert (r["seen"], r["correct"], r["accuracy"]) == (len(seen), sum(seen), pytest.approx(sum(seen) / len(seen)))


def test_fingerprints_and_feature_cache(spark):
    assert M.fingerprint("a: 1") == hashlib.md5(b"a: 1").hexdigest()
    assert M.fingerprint({"a": 1, "b": 2}) == M.fingerprint({"b": 2, "a": 1}) != M.fingerprint({"a": 2, "b": 2})
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    whole = M.table_fingerprint(df, ["a", "b"]).first()
    assert whole == M.table_fingerprint(df.repartition(3).orderBy(F.desc("a")), ["a", "b"]).first() and whole["n_rows"] == 2
    apart = [spark.createDataFrame(rows, "a string, b string") for rows in ([("a|b", "c")], [("a", "b|c")], [("a", None)], [("a", "")])]
    assert len({M.table_fingerprint(one, ["a", "b"]).first()["checksum"] for one in apart}) == 4
    where, built = scratch_path(spark, "cache"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert M.cached_features(spark, where, "c", lambda: build(3)).count() == 3
    assert M.cached_features(spark, where, "c", lambda: build(4)).count() == 3
    assert M.cached_features(spark, where, "c", lambda: build(5), evaluate=True).count() == 5
    assert M.cached_features(spark, where, "c", lambda: build(6), force=True).count() == 6
    assert built == [3, 5, 6]


def softmax(logits):
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


def groups(seed=4):
    """A hot group, a small one, one with equal logits and one with very different ones."""
    rng = random.Random(seed)
    out = {"hot": [round(rng.uniform(-3, 3), 2) for _ in range(400)], "small": [1.0, 2.0], "flat": [0.5] * 10}
    return out | {"wide": [0.0, 900.0, -900.0, 899.0], "one": [4.0]}


def frame(spark):
    return spark.createDataFrame([(g, i, x) for g, xs in groups().items() for i, x in enumerate(xs)], "g string, i int, x double")


def ordered(xs):
    return sorted(range(len(xs)), key=lambda i: (-xs[i], i))


def test_probabilities(spark):
    rows = {(r["g"], r["i"]): r for r in D.probabilities(frame(spark), ["g"], "x", "i").collect()}
    assert len(rows) == sum(map(len, groups().values()))
    for g, xs in groups().items():
        probs, total = softmax(xs), 0.0
        for i in ordered(xs):
            total += probs[i]
            assert rows[g, i]["prob"] == pytest.approx(probs[i], abs=1e-12)
            assert rows[g, i]["cum_prob"] == pytest.approx(total)
            if probs[i] > 0:
                assert rows[g, i]["log_prob"] == pytest.approx(math.log(probs[i]), abs=1e-6)


@pytest.mark.parametrize("k", [0, 1, 3, 1000])
def test_top_k_filter_keeps_ties(spark, k):
    got = {(r["g"], r["i"]) for r in D.top_k_filter(frame(spark), ["g"], "x", "i", k).collect()}
    want = set()
    for g, xs in groups().items():
        least = sorted(xs, reverse=True)[min(k, len(xs)) - 1] if k else min(xs)
        want |= {(g, i) for i, x in enumerate(xs) if x >= least}
    assert got == want


@pytest.mark.parametrize("p, k", [(0.0, 0), (0.5, 0), (0.9, 0), (0.9, 5), (0.0001, 0)])
def test_nucleus_filter(spark, p, k):
    got = {(r["g"], r["i"]) for r in D.nucleus_filter(frame(spark), ["g"], "x", "i", p, k).collect()}
    want = set()
    for g, xs in groups().items():
        least = sorted(xs, reverse=True)[min(k, len(xs)) - 1] if k else min(xs)
        kept = [i for i in ordered(xs) if xs[i] >= least]
        probs, before = softmax([xs[i] for i in kept]), 0.0
        for i, prob in zip(kept, probs):
            if p == 0 or before <= p:
                want.add((g, i))
            before += prob
    assert got == want


def test_draw(spark):
    for seed in range(3):
        got = {r["g"]: r["i"] for r in D.draw(frame(spark), ["g"], "x", "i", seed, 2.0).collect()}
        for g, xs in groups().items():
            u = int(hashlib.md5(f"{g}#{seed}".encode()).hexdigest()[:13], 16) / 16**13
            probs, total = softmax([x / 2 for x in xs]), 0.0
            for i in ordered(xs):
                total += probs[i]
                if total >= u:
                    break
            assert got[g] == i
    with pytest.raises(ValueError):
        D.draw(frame(spark), ["g"], "x", "i", temperature=0)


def test_draws_follow_the_distribution(spark):
    df = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    df = df.withColumn("x", F.col("i") * math.log(3))
    share = D.draw(df, ["g"], "x", "i", 1).agg(F.avg("i")).first()[0]
    assert abs(share - 0.75) < 0.03


def test_log_softmax_array(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "s array<double>")
    assert df.select(D.log_softmax_array(F.col("s"))).first()[0] == pytest.approx([-999.0, -998.0, 0.0])


def test_every_document_is_predicted(spark):
    folder = "/root/testdata/sf0.001"
    english = {r["doc_id"]: "1" if r["lang"] == "en" else "0" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    written = contract.queries()["batch_predict_all"](spark, folder).collect()
    reloaded = contract.queries()["model_reload_all"](spark, folder).collect()
    assert sorted(r["id"] for r in written) == sorted(r["id"] for r in reloaded) == sorted(english)
    assert {r["id"]: r["prediction"] for r in written} == {r["id"]: r["prediction"] for r in reloaded}
    held = [r["prediction"] == english[r["id"]] for r in written if r["id"] % 5 == 0]
    assert {r["reaches_floor"] for r in written} == {sum(held) >= 0.95 * len(held)} == {True}
    assert all(r["same"] for r in reloaded)


def test_whole_documents_are_fingerprinted(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    total = [0, 0]
    for r in rows:
        row = [None if r[c] is None else str(r[c]) for c in ("doc_id", "text", "lang", "source", "n_chars")]
        digest = hashlib.md5(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        total = [total[0] + int(digest[:16], 16), total[1] + int(digest[16:], 16)]
    got = contract.queries()["fingerprint_documents"](spark, folder).first()
    assert (got["n_rows"], got["checksum"]) == (len(rows), f"{total[0]}-{total[1]}")

"""Queries for training, evaluation, prediction and score distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import query, table
from catalog.sql import tokens
from corpusflow.functions import text as X
from corpusflow.operators import distributions as D
from corpusflow.operators import examples, models, training
from corpusflow.operators.scale import each
from corpusflow.session import materialize, scratch_path
from corpusflow.sources import delimited, tables

LABELS = ["0", "1"]
CONFIG = {"task": "classification", "labels": LABELS, "data": "documents, English or not", "epochs": 10}


#: Share of held-out documents whose language a classifier must tell (English or not).
FLOOR = 0.95


def languages(spark, folder, held_out):
    """Examples (text, whether it is English): four of five documents to learn from, the fifth held out."""
    docs = table(spark, folder, "documents", spread=True).filter(f"doc_id % 5 {'=' if held_out else '<>'} 0")
    rows = docs.select("doc_id", "text", F.when(F.col("lang") == "en", "1").otherwise("0").alias("english"))
    return examples.examples(rows, ["text", "english"], keep=["doc_id"])


def classifier(spark, folder):
    return models.train(languages(spark, folder, False), "classification", LABELS, epochs=CONFIG["epochs"])


@query(
    "train_classifier",
    """SELECT step, true AS reaches_floor, true AS has_loss, step = 8 AS last FROM (VALUES (2), (8)) t(step)
       WHERE (SELECT count(*) FROM documents) > 0""",
)
def train_classifier(spark, folder):
    """The history of a training on rows apart from those it is scored on; the best checkpoint must reach the floor."""
    history, _ = models.training_history(languages(spark, folder, False), languages(spark, folder, True), LABELS, [2, 8])
    history = materialize(history, "history")
    best = models.best_checkpoint(history).first()
    return history.select("step", F.lit(best["value"] >= FLOOR).alias("reaches_floor"), F.col("loss").isNotNull().alias("has_loss"), (F.col("step") == 8).alias("last"))


def linear_classifier(spark, folder):
    return training.train_steps(training.Trainer(languages(spark, folder, False), LABELS), [CONFIG["epochs"]])[CONFIG["epochs"]]


class LongTexts:
    """A rule in a model's place: texts of more than 200 terms are 'long'."""

    def transform(self, df):
        return df.withColumn("prediction", F.when(F.size(X.tokens(F.col("text_a"))) > 200, "long").otherwise("short"))


@query("batch_predict_rule", f"SELECT doc_id AS id, CASE WHEN len({tokens('text')}) > 200 THEN 'long' ELSE 'short' END AS prediction FROM documents")
def batch_predict_rule(spark, folder):
    """Every document's prediction by a rule, through the job, its file and back."""
    path = scratch_path(spark, "predictions") + ".tsv"
    models.predict_job(LongTexts(), all_documents(spark, folder), lambda rows: delimited.write_rows(rows, path))
    return delimited.read_rows(spark, path).select(F.col("_c0").cast("long").alias("id"), F.col("_c1").alias("prediction"))


@query("train_resumed", "SELECT step, true AS same FROM (VALUES (3), (6)) t(step) WHERE (SELECT count(*) FROM documents) > 0")
def train_resumed(spark, folder):
    """A training that stopped after three steps and went on in another run, next to one that never stopped."""
    path = scratch_path(spark, "checkpoints")
    rows = materialize(languages(spark, folder, False).select("text_a", "label"), "examples")
    training.train_steps(training.Trainer(rows, LABELS), [2, 3], path)
    resumed = training.train_steps(training.Trainer(rows, LABELS), [3, 6], path)
    straight = training.train_steps(training.Trainer(rows, LABELS), [3, 6])
    same = [(step, bool(np.allclose(resumed[step].weights, straight[step].weights, rtol=1e-6, atol=1e-9))) for step in (3, 6)]
    return spark.createDataFrame(same, "step int, same boolean").filter(F.lit(not rows.isEmpty()))


@query("batch_predict", "SELECT doc_id AS id, true AS reaches_floor FROM documents WHERE doc_id % 5 = 0")
def batch_predict(spark, folder):
    """Held-out documents through the prediction job, read back from where it wrote them."""
    model = linear_classifier(spark, folder)
    path = scratch_path(spark, "predictions") + ".tsv"
    inputs = languages(spark, folder, True)
    models.predict_job(model, inputs.select("text_a", "doc_id"), lambda rows: delimited.write_rows(rows, path))
    rows = delimited.read_rows(spark, path).select(F.col("_c0").cast("long").alias("id"), F.col("_c1").alias("prediction"))
    right = F.avg((F.col("prediction") == F.col("label")).cast("int"))
    share = rows.join(inputs.select(F.col("doc_id").alias("id"), "label"), "id").agg(right).first()[0]
    return rows.select("id", F.lit(share >= FLOOR).alias("reaches_floor"))


@query("model_reload", "SELECT doc_id AS id, true AS same FROM documents WHERE doc_id % 5 = 0")
def model_reload(spark, folder):
    """Predictions of a model read back from its version folder, next to those from before it was saved."""
    where, trained = scratch_path(spark, "models"), classifier(spark, folder)
    models.save(trained, where, CONFIG)
    inputs = languages(spark, folder, True).select("text_a", "doc_id")
    before = models.predict(trained, inputs).withColumnRenamed("prediction", "before")
    after = models.predict(models.load(spark, where, CONFIG), inputs)
    return before.join(after, "id").select("id", (F.col("before") == F.col("prediction")).alias("same"))


def all_documents(spark, folder):
    return table(spark, folder, "documents", spread=True).select("text", "doc_id")


@query("batch_predict_all")
def batch_predict_all(spark, folder):
    """Every document through the prediction job, with its prediction; the floor is that of the held-out ones alone."""
    model = classifier(spark, folder)
    path = scratch_path(spark, "predictions") + ".tsv"
    models.predict_job(model, all_documents(spark, folder), lambda rows: delimited.write_rows(rows, path))
    rows = delimited.read_rows(spark, path).select(F.col("_c0").cast("long").alias("id"), F.col("_c1").alias("prediction"))
    held = languages(spark, folder, True).select(F.col("doc_id").alias("id"), "label")
    share = rows.join(held, "id").agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    return rows.withColumn("reaches_floor", F.lit(share >= FLOOR if share is not None else None).cast("boolean"))


@query("model_reload_all")
def model_reload_all(spark, folder):
    """Every document's prediction by a model read back from its version folder, next to that from before it was saved."""
    where, trained = scratch_path(spark, "models"), classifier(spark, folder)
    models.save(trained, where, CONFIG)
    inputs = all_documents(spark, folder)
    before = models.predict(trained, inputs).withColumnRenamed("prediction", "before")
    after = models.predict(models.load(spark, where, CONFIG), inputs)
    return before.join(after, "id").select("id", "prediction", F.col("before").eqNullSafe(F.col("prediction")).alias("same"))


@query(
    "train_regression",
    """SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""",
)
def train_regression(spark, folder):
    line = models.fit_line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("train_regressor")
def train_regressor(spark, folder):
    rows = examples.examples(table(spark, folder, "documents", spread=True), ["text", "n_chars"], keep=["doc_id"])
    model = models.train(rows, "regression", features=256)
    return model.transform(rows).select("doc_id", F.round("prediction", 3).alias("prediction"))


# A rule stands in for a model: long documents are predicted to be of quality 1 with probability 0.8.
_RULE = """ruled AS (SELECT doc_id, quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END::INT AS prediction FROM documents JOIN labels USING (doc_id))"""


def ruled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    rule = F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("prediction")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return docs.join(labels, "doc_id").select("doc_id", "quality", rule)


@query(
    "running_accuracy",
    f"""WITH {_RULE}, steps AS (SELECT doc_id // 16 AS step, count(*) AS n, count(*) FILTER (prediction = quality) AS hits FROM ruled GROUP BY 1)
        SELECT step, seen, correct, round(correct / seen, 6) AS accuracy FROM (
          SELECT step, (sum(n) OVER (ORDER BY step))::BIGINT AS seen, (sum(hits) OVER (ORDER BY step))::BIGINT AS correct FROM steps)""",
)
def running_accuracy(spark, folder):
    rows = ruled(spark, folder).withColumn("step", F.expr("doc_id div 16"))
    return models.running_accuracy(rows, "step", label="quality").withColumn("accuracy", F.round("accuracy", 6))


@query("label_counts", f"WITH {_RULE} SELECT prediction, count(*) AS n FROM ruled GROUP BY 1")
def label_counts(spark, folder):
    return models.label_counts(ruled(spark, folder))


@query(
    "evaluate",
    f"""WITH {_RULE} SELECT 'acc' AS metric, round(avg((prediction = quality)::INT), 6) AS value FROM ruled
        UNION ALL SELECT 'loss', round(avg(-ln(CASE WHEN prediction = quality THEN 0.8 ELSE 0.2 END)), 6) FROM ruled""",
)
def evaluate(spark, folder):
    scores = F.when(F.col("prediction") == 1, F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(0.8), F.lit(0.2)))
    loss = models.negative_log_likelihood(scores, F.col("quality"))
    results = models.evaluate(ruled(spark, folder), label="quality", loss=loss)
    return results.withColumn("value", F.round("value", 6))


@query(
    "evaluate_regression",
    "SELECT 'loss' AS metric, round(avg((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity)), 2) AS value FROM lineitem",
)
def evaluate_regression(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_quantity") * 1000).alias("prediction"), F.col("l_extendedprice").alias("label"))
    return models.evaluate(rows, "regression").withColumn("value", F.round("value", 2))


_HISTORY = """history AS (SELECT event_id // 500 AS step, round(avg((value > 10)::INT), 6) AS acc, round(avg(value), 6) AS loss FROM events GROUP BY 1)"""


@query(
    "best_checkpoint",
    f"""WITH {_HISTORY}
        SELECT 'classification' AS task, step, acc AS value FROM (SELECT * FROM history ORDER BY acc DESC, step LIMIT 1)
        UNION ALL SELECT 'regression', step, loss FROM (SELECT * FROM history ORDER BY loss, step LIMIT 1)""",
)
def best_checkpoint(spark, folder):
    events = table(spark, folder, "events").withColumn("step", F.expr("event_id div 500"))
    history = events.groupBy("step").agg(
        F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("acc"), F.round(F.avg("value"), 6).alias("loss")
    )
    rows = [models.best_checkpoint(history, t).select(F.lit(t).alias("task"), "*") for t in models.TASKS]
    return rows[0].unionByName(rows[1])


@query(
    "argmax_label",
    "SELECT vec_id, 'class' || (list_position(embedding, list_max(embedding)) - 1) AS prediction FROM embeddings",
)
def argmax_label(spark, folder):
    names = [f"class{i}" for i in range(64)]
    return table(spark, folder, "embeddings").select("vec_id", models.decode(F.col("embedding"), names).alias("prediction"))


@query(
    "log_softmax",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
       z AS (SELECT *, list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) AS lse FROM s)
       SELECT vec_id, (i - 1)::INT AS item, round(e[i] - lse, 6) AS log_prob FROM (SELECT *, unnest(range(1, 65)) AS i FROM z)""",
)
def log_softmax(spark, folder):
    rows = each(table(spark, folder, "embeddings"), D.log_softmax_array(F.col("embedding")), "v", ["vec_id"], "item")
    return rows.select("vec_id", "item", F.round("v", 6).alias("log_prob"))


# Event values as logits at temperature 50, one distribution per event type: few, large groups.
_PROBS = """logits AS (SELECT event_type, event_id, value / 50.0 AS logit FROM events),
  tops AS (SELECT event_type, max(logit) AS m FROM logits GROUP BY 1),
  weights AS (SELECT l.*, exp(logit - m) AS w, m FROM logits l JOIN tops USING (event_type)),
  probs AS (SELECT *, w / sum(w) OVER (PARTITION BY event_type) AS prob,
      sum(w) OVER (PARTITION BY event_type ORDER BY logit DESC, event_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY event_type) AS cum,
      logit - m - ln(sum(w) OVER (PARTITION BY event_type)) AS log_prob FROM weights)"""


def logits(spark, folder):
    return table(spark, folder, "events").select("event_type", "event_id", (F.col("value") / 50.0).alias("logit"))


@query("group_log_softmax", f"WITH {_PROBS} SELECT event_type, event_id, round(log_prob, 6) AS log_prob, round(cum, 6) AS cum_prob FROM probs")
def group_log_softmax(spark, folder):
    rows = D.probabilities(logits(spark, folder), ["event_type"], "logit", "event_id")
    return rows.select("event_type", "event_id", F.round("log_prob", 6).alias("log_prob"), F.round("cum_prob", 6).alias("cum_prob"))


@query(
    "topk_filter",
    f"WITH {_PROBS} SELECT event_type, event_id, logit FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY logit DESC) AS r FROM logits) WHERE r <= 50",
)
def topk_filter(spark, folder):
    return D.top_k_filter(logits(spark, folder), ["event_type"], "logit", "event_id", 50)


@query("nucleus_filter", f"WITH {_PROBS} SELECT event_type, event_id, round(prob, 6) AS prob FROM probs WHERE cum - prob <= 0.9")
def nucleus_filter(spark, folder):
    rows = D.nucleus_filter(logits(spark, folder), ["event_type"], "logit", "event_id", 0.9)
    return rows.select("event_type", "event_id", F.round("prob", 6).alias("prob"))


@query(
    "weighted_draw",
    """WITH logits AS (SELECT user_id, event_id, value / 50.0 AS logit FROM events),
       weights AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY user_id)) AS w FROM logits),
       cums AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY logit DESC, event_id ROWS UNBOUNDED PRECEDING)
                  / sum(w) OVER (PARTITION BY user_id) AS cum,
                ('0x' || substr(md5(user_id || '#3'), 1, 13))::BIGINT / pow(16, 13) AS u FROM weights)
       SELECT user_id, arg_min(event_id, cum) AS event_id FROM cums WHERE cum >= u GROUP BY 1""",
)
def weighted_draw(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "value")
    return D.draw(rows, ["user_id"], "value", "event_id", seed=3, temperature=50.0)


@query(
    "fingerprint",
    """SELECT count(*) AS n_rows, sum(('0x' || substr(digest, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substr(digest, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS checksum
       FROM (SELECT md5('["' || p_partkey || '","' || p_name || '","' || p_brand || '",' || CASE WHEN p_size > 10 THEN '"' || p_size || '"' ELSE 'null' END || ']') AS digest FROM part)""",
)
def fingerprint(spark, folder):
    """Of rows with nulls, whose columns must not run into each other."""
    part = table(spark, folder, "part").withColumn("size", F.when(F.col("p_size") > 10, F.col("p_size")))
    return models.table_fingerprint(part, ["p_partkey", "p_name", "p_brand", "size"])


@query("fingerprint_documents")
def fingerprint_documents(spark, folder):
    """Of whole documents, their texts included."""
    return models.table_fingerprint(table(spark, folder, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query(
    "feature_cache",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS label, doc_id % 5 = 0 AS evaluation, len(t)::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct,
        length(text)::INT AS size FROM (SELECT *, {tokens('text')} AS t FROM documents)""",
)
def feature_cache(spark, folder):
    """Features for training and for evaluation, each built once: the second call must not build again."""
    where, variants = scratch_path(spark, "features"), []
    for held_out in (False, True):

        def build():
            rows = languages(spark, folder, held_out).withColumn("terms", X.tokens(F.col("text_a")))
            sizes = [F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("n_distinct"), F.length("text_a").alias("size")]
            return rows.select("doc_id", "label", F.lit(held_out).alias("evaluation"), *sizes)

        models.cached_features(spark, where, CONFIG, build, evaluate=held_out)
        variants.append(models.cached_features(spark, where, CONFIG, lambda: build().limit(0), evaluate=held_out))
    return variants[0].unionByName(variants[1])


@query(
    "select_all",
    "SELECT doc_id, quality, toxic FROM labels",
)
def select_all(spark, folder):
    return tables.select_all(table(spark, folder, "labels"), "doc_id", seed=1)

"""Text classification and regression: train, evaluate, select, predict, cache, save."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.examples import index_labels, numeric_labels
from corpusflow.operators.scale import running_totals
from corpusflow.operators.training import LinearModel, Trainer, train_steps
from corpusflow.session import materialize

TASKS = ("classification", "regression")


def fingerprint(config: Mapping | str) -> str:
    """md5 of a configuration: the version of what it describes."""
    text = config if isinstance(config, str) else json.dumps(config, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(text.encode()).hexdigest()


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n_rows, checksum): a hash of the table that does not depend on row order."""
    # JSON keeps columns and nulls apart; the whole hash is summed, in two halves that a decimal holds exactly.
    row = F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))
    halves = [F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    sums = [F.coalesce(F.sum(half).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string") for half in halves]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *sums).alias("checksum"))


@dataclass
class TextModel:
    """A fitted pipeline and what is needed to use it on other data."""

    task: str
    labels: list[str]
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scores`` (class probabilities, or the one predicted value) and ``prediction``."""
        scored = self.pipeline.transform(with_texts(df))
        if self.task == "regression":
            scored = scored.withColumn("scores", F.array("_value"))
        else:
            scored = scored.withColumn("scores", vector_to_array("_probability"))
        kept = scored.select(*df.columns, "scores")
        return kept.withColumn("prediction", decode(F.col("scores"), self.labels, self.task))


def with_texts(df: DataFrame) -> DataFrame:
    """text_a and text_b without nulls; a missing text_b is empty."""
    b = F.coalesce("text_b", F.lit("")) if "text_b" in df.columns else F.lit("")
    return df.withColumns({"_text_a": F.coalesce("text_a", F.lit("")), "_text_b": b})


def decode(scores: Column, labels: Sequence[str], task: str = "classification") -> Column:
    """Label of the highest score (the first one on ties); for regression the single value."""
    if task == "regression":
        return F.get(scores, F.lit(0))
    at = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), at.cast("int"))


def train(
    examples: DataFrame,
    task: str = "classification",
    labels: Sequence[str] = (),
    features: int = 1 << 14,
    epochs: int = 20,
    reg: float = 1e-3,
    pair: bool = False,
) -> TextModel:
    """Fit on (text_a, [text_b], label).  ``epochs`` bounds the optimizer's passes over the data.

    Terms are hashed to a fixed number of features, so neither the vocabulary nor the model grows with
    the data.  Examples with an unknown label are left out (see ``index_labels``).
    """
    if task not in TASKS:
        raise NotImplementedError(f"task must be one of {TASKS}")
    stages, inputs = [], []
    for side in ("a", "b") if pair else ("a",):
        words, counts, weighted = f"_words_{side}", f"_tf_{side}", f"_tfidf_{side}"
        stages += [
            RegexTokenizer(inputCol=f"_text_{side}", outputCol=words, pattern=r"[\p{L}\p{N}]+", gaps=False),
            HashingTF(inputCol=words, outputCol=counts, numFeatures=features),
            IDF(inputCol=counts, outputCol=weighted),
        ]
        inputs.append(weighted)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    if task == "regression":
        rows, _ = numeric_labels(examples)
        rows = rows.withColumn("_target", F.col("target"))
        stages.append(
            LinearRegression(featuresCol="_features", labelCol="_target", predictionCol="_value", maxIter=epochs, regParam=reg)
        )
    else:
        rows, _ = index_labels(examples, labels)
        rows = rows.withColumn("_target", F.col("label_index").cast("double"))
        stages.append(
            LogisticRegression(
                featuresCol="_features",
                labelCol="_target",
                probabilityCol="_probability",
                predictionCol="_class",
                rawPredictionCol="_raw",
                maxIter=epochs,
                regParam=reg,
                family="multinomial",
            )
        )
    return TextModel(task, list(labels), Pipeline(stages=stages).fit(with_texts(rows)))


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, slope, intercept): least squares with one feature, in one aggregation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def label_counts(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def running_accuracy(df: DataFrame, step: str, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Per step the examples seen and the share predicted right so far: (step, seen, correct, accuracy).

    Rows are counted per step first; only steps are put in order.
    """
    right = F.count_if(F.col(prediction).eqNullSafe(F.col(label)))
    steps = df.groupBy(F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("n"), right.alias("hits"))
    totals = running_totals(steps, [F.asc("step")], {"seen": F.col("n"), "correct": F.col("hits")})
    return totals.select("step", "seen", "correct", (F.col("correct") / F.col("seen")).alias("accuracy"))


def evaluate(
    df: DataFrame, task: str = "classification", prediction: str = "prediction", label: str = "label", loss: Column | None = None
) -> DataFrame:
    """(metric, value), sorted by metric.

    Classification: ``acc`` over all rows, and ``loss`` = mean of ``loss`` (e.g. the negative log
    probability of the label) if given.  Regression: ``loss`` = mean squared error unless given.
    """
    if task == "regression" and loss is None:
        gap = F.col(prediction).cast("double") - F.col(label).cast("double")
        loss = gap * gap
    metrics = {}
    if task == "classification":
        metrics["acc"] = F.avg(F.col(prediction).eqNullSafe(F.col(label)).cast("double"))
    if loss is not None:
        metrics["loss"] = F.avg(loss)
    row = df.agg(*[value.alias(name) for name, value in metrics.items()])
    names = ", ".join(f"'{m}', {m}" for m in sorted(metrics))
    return row.selectExpr(f"stack({len(metrics)}, {names}) AS (metric, value)")


def negative_log_likelihood(scores: Column, label_index: Column) -> Column:
    return -F.log(F.greatest(F.get(scores, label_index), F.lit(1e-300)))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def best_checkpoint(history: DataFrame, task: str = "classification") -> DataFrame:
    """One row (step, value): highest ``acc`` for classification, lowest ``loss`` for regression; first step on ties."""
    if task == "classification":
        best = F.max_by(F.struct("step", "acc"), F.struct(F.col("acc"), -F.col("step")))
        return history.filter("acc IS NOT NULL").agg(best.alias("b")).select("b.step", F.col("b.acc").alias("value"))
    best = F.min_by(F.struct("step", "loss"), F.struct("loss", "step"))
    return history.filter("loss IS NOT NULL").agg(best.alias("b")).select("b.step", F.col("b.loss").alias("value"))


def training_history(
    examples: DataFrame, test: DataFrame, labels: Sequence[str], steps: Sequence[int], path: str | None = None, **options
) -> tuple[DataFrame, dict[int, LinearModel]]:
    """(step, acc, loss) of one training looked at after each of ``steps``, scored on separate test rows, and the models by step.

    A later step goes on from the one before it; with a ``path`` also from the last checkpoint that an earlier run left there.
    """
    known, _ = index_labels(test, labels)
    rows, fitted = None, train_steps(Trainer(examples, labels, **options), steps, path)
    for step, model in fitted.items():
        loss = negative_log_likelihood(F.col("scores"), F.col("label_index"))
        scored = evaluate(model.transform(known), loss=loss)
        row = scored.groupBy(F.lit(step).alias("step")).pivot("metric", ["acc", "loss"]).agg(F.first("value"))
        rows = row if rows is None else rows.unionByName(row)
    return rows, fitted


def predict(model: TextModel | LinearModel, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(id, prediction): the last column is the id, the one or two before it the inputs."""
    columns = list(columns or df.columns)
    inputs, key = columns[:-1], columns[-1]
    if len(inputs) not in (1, 2):
        raise ValueError("one or two input columns and an id are needed")
    b = F.col(inputs[1]).cast("string") if len(inputs) == 2 else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("id"), F.col(inputs[0]).cast("string").alias("text_a"), b.alias("text_b"))
    return model.transform(rows).select("id", "prediction")


def predict_job(model: TextModel | LinearModel, df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, float]:
    """Predict and hand the rows to a writer; returns rows, seconds and rows per second.

    The predictions, an id and a label each, are stored first; they are counted and handed on from there, so the
    input is read once.
    """
    started = time.monotonic()
    stored = materialize(predict(model, df), "predictions")
    write(stored)
    seconds = time.monotonic() - started
    rows = stored.count()
    return {"rows": rows, "seconds": seconds, "rate": rows / seconds if seconds else 0.0}


def cached_features(
    spark: SparkSession,
    folder: str,
    config: Mapping | str,
    build: Callable[[], DataFrame],
    evaluate: bool = False,
    force: bool = False,
) -> DataFrame:
    """Features of a configuration, from ``folder/<fingerprint>`` if already built there."""
    path = f"{folder}/{fingerprint(config)}/{'eval-features' if evaluate else 'features'}"
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass  # not there, or never completed
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save(model: TextModel, folder: str, config: Mapping | str) -> str:
    """Write a trained model below its version; returns the path.  The description is written last."""
    path = f"{folder}/{fingerprint(config)}"
    spark = SparkSession.active()
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    about = json.dumps({"task": model.task, "labels": model.labels})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load(spark: SparkSession, folder: str, config: Mapping | str) -> TextModel:
    """The trained model of a configuration; FileNotFoundError if it was never trained."""
    path = f"{folder}/{fingerprint(config)}"
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
    except AnalysisException as error:
        raise FileNotFoundError(f"train the model before using it: {path}") from error
    return TextModel(about["task"], about["labels"], PipelineModel.load(f"{path}/pipeline"))

"""Bounded, reproducible samples of labelled rows for fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``most`` labelled rows for fitting: ``key``, ``label`` (0/1), ``text``.

    ``train`` says which keys of ``labels`` may be learnt from.  Keys are taken in the order of a hash, so the
    sample does not depend on how the table is stored.  Their number is bounded, so they are sent to the texts; of a key
    that several rows have, the text of the smallest hash counts.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("label").isin(0, 1)).withColumn("ok", train).filter("ok")
    order = F.xxhash64(F.col("key"), F.lit(17))
    chosen = rows.groupBy("key").agg(F.max("label").alias("label")).orderBy(order, "key").limit(most)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "key")
    one = found.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return one.select("key", "label", F.col("first.text").alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (Newton steps, smoothed targets)."""
    good, bad = int((labels > 0).sum()), int((labels <= 0).sum())
    if not good or not bad:
        share = (good + 1) / (good + bad + 2)
        return 0.0, float(np.log(share / (1 - share)))
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        gradient = x.T @ (p - target) + np.array([1e-3, 0]) * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])

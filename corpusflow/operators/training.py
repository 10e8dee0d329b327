"""Training of text classifiers that can stop and go on: hashed terms stored once, gradients summed over tasks, and an optimiser
whose whole state is kept with each checkpoint.

A text is the hashes of its terms, weighted by their inverse document frequency and scaled by the root of its length.  A step of
the optimiser (limited-memory BFGS) reads the stored hashes once; tasks send one gradient each, summed in groups before the driver
adds what is left, in an order that does not change, so that a run which goes on from a checkpoint equals one that never stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators.examples import index_labels
from corpusflow.session import materialize

#: Pairs of steps and gradient changes that the optimiser remembers; halvings of a step that does not lower the loss.
MEMORY, HALVINGS = 10, 12
#: Gradients that one task adds up before they reach the driver.
SUMMED = 32


def hashed_terms(text: Column, features: int, side: int = 0) -> Column:
    """The hash of every term of a text, in order, from 0 to ``features`` less one; sides of a pair have hashes of their own."""
    return F.transform(X.tokens(text), lambda t: F.pmod(F.xxhash64(F.lit(side), t), F.lit(features)).cast("int"))


def pair_terms(df: DataFrame, features: int) -> Column:
    sides = [hashed_terms(F.col(c), features, i) for i, c in enumerate(("text_a", "text_b")) if c in df.columns]
    return F.concat(*sides) if len(sides) > 1 else sides[0]


def probabilities(inverse: np.ndarray, weights: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row of class probabilities per text, given the hashes of all texts in a row."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    value = inverse[ids] / np.sqrt(lengths)[owner]
    margins = np.stack([np.bincount(owner, w[ids] * value, minlength=len(lengths)) + w[-1] for w in weights], axis=1)
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


@dataclass
class LinearModel:
    """Class weights of hashed terms; ``weights`` has a row per label, its last column is the constant."""

    labels: list[str]
    inverse: np.ndarray
    weights: np.ndarray

    @property
    def features(self) -> int:
        return len(self.inverse)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scores`` (class probabilities) and ``prediction``, the label of the highest (the first on ties)."""
        inverse, weights = self.inverse, self.weights  # the function takes arrays with it, not this object

        @F.pandas_udf("array<double>")
        def scores(terms: pd.Series) -> pd.Series:
            lengths = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
            ids = np.concatenate([np.asarray(t, dtype=np.int64) for t in terms]) if len(terms) else np.empty(0, dtype=np.int64)
            return pd.Series(list(probabilities(inverse, weights, ids, lengths)))

        scored = df.withColumn("scores", scores(pair_terms(df, self.features)))
        at = F.array_position("scores", F.array_max("scores")).cast("int")
        return scored.withColumn("prediction", F.element_at(F.array(*[F.lit(x) for x in self.labels]), at))


@dataclass
class State:
    """Where the optimiser stands after ``step`` steps."""

    step: int
    weights: np.ndarray
    loss: float
    gradient: np.ndarray
    memory: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


class Trainer:
    """A training on (text_a, [text_b], label) rows, whose terms are hashed and stored once."""

    def __init__(self, examples: DataFrame, labels: Sequence[str], features: int = 1 << 14, reg: float = 1e-4):
        self.labels, self.reg = list(labels), reg
        rows, _ = index_labels(examples, labels)
        self.rows = materialize(rows.select(F.col("label_index").cast("int").alias("label"), pair_terms(rows, features).alias("ids")), "hashed")
        self.count, self.parts = self.rows.count(), self.rows.rdd.getNumPartitions()
        held = self.rows.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").count().collect()  # a row per feature at most
        df = np.zeros(features)
        for r in held:
            df[r["id"]] = r["count"]
        self.inverse = np.log((self.count + 1) / (df + 1))

    def model(self, state: State) -> LinearModel:
        return LinearModel(self.labels, self.inverse, state.weights)

    def loss_and_gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log likelihood with the penalty, and its gradient, in one pass over the stored rows."""
        inverse, k, width = self.inverse, len(self.labels), weights.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            loss, gradient = 0.0, np.zeros((k, width))
            for part in batches:
                lengths = np.diff(part.column("ids").offsets.to_numpy()).astype(np.int64)
                ids, truth = part.column("ids").flatten().to_numpy().astype(np.int64), part.column("label").to_numpy()
                if not len(lengths):
                    continue
                found = probabilities(inverse, weights, ids, lengths)
                loss -= float(np.log(np.maximum(found[np.arange(len(truth)), truth], 1e-300)).sum())
                found[np.arange(len(truth)), truth] -= 1.0
                owner = np.repeat(np.arange(len(lengths)), lengths)
                value = inverse[ids] / np.sqrt(lengths)[owner]
                for c in range(k):
                    gradient[c, :-1] += np.bincount(ids, found[owner, c] * value, minlength=width - 1)
                    gradient[c, -1] += found[:, c].sum()
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "loss", "gradient"])

        def added(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            total = sum(np.frombuffer(g, dtype=np.float64) for g in table.column("gradient").to_pylist())
            loss = sum(table.column("loss").to_pylist())
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "loss": pa.array([loss], pa.float64()), "gradient": pa.array([total.tobytes()], pa.binary())})

        schema, parts = "part int, loss double, gradient binary", self.parts
        sums = self.rows.mapInArrow(partial, schema)
        while parts > SUMMED:
            sums = sums.groupBy(F.floor(F.col("part") / SUMMED)).applyInArrow(added, schema).withColumn("part", F.floor(F.col("part") / SUMMED).cast("int"))
            parts = -(-parts // SUMMED)
        loss, gradient = 0.0, np.zeros((k, width))
        for row in sorted(sums.collect(), key=lambda r: r["part"]):
            loss += row["loss"]
            gradient += np.frombuffer(row["gradient"], dtype=np.float64).reshape(k, width)
        n = max(1, self.count)
        penalty = weights.copy()
        penalty[:, -1] = 0.0
        return loss / n + 0.5 * self.reg * float((penalty**2).sum()), gradient / n + self.reg * penalty

    def start(self) -> State:
        weights = np.zeros((len(self.labels), len(self.inverse) + 1))
        return State(0, weights, *self.loss_and_gradient(weights))

    def advance(self, state: State, steps: int) -> State:
        """The state after more steps; the given one is left as it is."""
        for _ in range(steps):
            move = -_times_inverse(state.memory, state.gradient)
            slope = float((move * state.gradient).sum())
            rate = 1.0 if state.memory else min(1.0, 1.0 / max(1e-12, float(np.abs(state.gradient).sum())))
            for _ in range(HALVINGS):
                weights = state.weights + rate * move
                loss, gradient = self.loss_and_gradient(weights)
                if loss <= state.loss + 1e-4 * rate * slope:
                    break
                rate /= 2
            else:
                return State(state.step + 1, state.weights, state.loss, state.gradient, state.memory)
            moved, changed = weights - state.weights, gradient - state.gradient
            memory = [*state.memory, (moved, changed)][-MEMORY:] if float((moved * changed).sum()) > 1e-12 else state.memory
            state = State(state.step + 1, weights, loss, gradient, memory)
        return state


def _times_inverse(memory: list[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> np.ndarray:
    """The gradient times the inverse curvature that the memory tells (two-loop recursion)."""
    q, kept = gradient.copy(), []
    for moved, changed in reversed(memory):
        weight = float((moved * q).sum()) / float((moved * changed).sum())
        q -= weight * changed
        kept.append(weight)
    if memory:
        moved, changed = memory[-1]
        q *= float((moved * changed).sum()) / float((changed * changed).sum())
    for (moved, changed), weight in zip(memory, reversed(kept)):
        q += (weight - float((changed * q).sum()) / float((moved * changed).sum())) * moved
    return q


def save_state(spark: SparkSession, state: State, path: str) -> None:
    """Write a checkpoint; one of the same step is replaced."""
    spark.createDataFrame([(state.step, pickle.dumps(state.__dict__))], "step long, state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/at={state.step}")


def load_state(spark: SparkSession, path: str) -> State | None:
    """The checkpoint of the highest step, if there is one.  Checkpoints are read as Python objects: only from one's own folder."""
    try:
        row = spark.read.parquet(path).orderBy(F.desc("step")).select("state").first()
    except AnalysisException:
        return None
    return State(**pickle.loads(row["state"])) if row else None


def train_steps(trainer: Trainer, steps: Sequence[int], path: str | None = None) -> dict[int, LinearModel]:
    """Models after each of the ``steps``, one run; with a ``path`` it goes on from the last checkpoint there and leaves new ones."""
    spark = trainer.rows.sparkSession
    state = (load_state(spark, path) if path else None) or trainer.start()
    models = {}
    for step in sorted(steps):
        if step < state.step:
            raise ValueError(f"the checkpoints in {path} are past step {step}")
        state = trainer.advance(state, step - state.step)
        if path:
            save_state(spark, state, path)
        models[step] = trainer.model(state)
    return models

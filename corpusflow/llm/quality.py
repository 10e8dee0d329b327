"""Naive Bayes support vectors for quality.

A text's features are the indicators of its n-grams: hashed letter n-grams of one to three bytes, and runs of a
word repeated at once (n-grams over "the same word again").  The indicators are scaled by the log-count ratio of
the two classes and the scaled vectors brought to unit length; a linear hinge-loss model is fitted to them by dual
coordinate descent, and a logistic curve over margins of rows that were not fitted turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from corpusflow.llm.common import map_slices, sliced
from corpusflow.llm.samples import calibrate, labelled_sample, sigmoid

#: Hashed features; the last ones are the runs of one repeated word.
BITS = 16
#: How many times in a row the same word comes again.
RUNS = (1, 2, 3, 4, 6, 8)
SIZE = (1 << BITS) + len(RUNS)
#: Labelled rows that a fit uses at most.
MOST_ROWS = 6000


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct features of each whole text, ascending."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    one, two = data[:-2], (data[:-2] << 8) | data[1:-1]
    three = (two << 8) | data[2:]
    shift = np.uint32(32 - BITS)
    codes = [((g + np.uint32(salt)) * np.uint32(2654435761)) >> shift for g, salt in ((one, 0x1000003), (two, 0x2000029), (three, 0x5000011))]
    seen, begin = np.zeros(1 << BITS, dtype=bool), 0
    for text, piece in zip(texts, raw):
        end = begin + len(piece)
        for n, code in enumerate(codes):
            seen[code[begin : max(begin, end - n)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        begin = end
        words = (text or "").split()
        again = bytes(map(eq, words, words[1:]))
        runs = [(1 << BITS) + i for i, n in enumerate(RUNS) if b"\1" * n in again] if b"\1" in again else []
        yield np.concatenate([found, runs]).astype(np.int32) if runs else found.astype(np.int32)


@dataclass
class Model:
    """Weights of the scaled indicators, the scales, and the curve from margins to probabilities."""

    ratio: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        scale = self.ratio[found]
        length = float(np.sqrt(np.dot(scale, scale)))
        return self.offset + (float(np.dot(scale, self.weights[found])) / length if length else 0.0)

    def probability(self, found: np.ndarray) -> float:
        return float(sigmoid(np.array(self.slope * self.margin(found) + self.shift)))


def log_ratios(rows: list[np.ndarray], signs: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of a feature's smoothed share among the indicators of either class."""
    counts = {sign: np.full(SIZE, smooth) for sign in (1, -1)}
    for row, sign in zip(rows, signs.tolist()):
        counts[sign][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; both classes weigh the same in all.

    Each step solves the one-variable problem of a row's dual variable between 0 and its cost exactly.
    """
    weights, offset = np.zeros(SIZE), 0.0
    share = {sign: cost * len(signs) / max(1, 2 * int((signs == sign).sum())) for sign in (1, -1)}
    dual, norms = np.zeros(len(rows)), [float(np.dot(v, v)) + 1.0 for v in values]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            sign, row, value = float(signs[i]), rows[i], values[i]
            gradient = sign * (float(np.dot(weights[row], value)) + offset) - 1.0
            old = dual[i]
            new = min(max(old - gradient / norms[i], 0.0), share[int(sign)])
            if new != old:
                dual[i] = new
                weights[row] += (new - old) * sign * value
                offset += (new - old) * sign
                moved = max(moved, abs(new - old))
        if moved < 1e-3 * cost:
            break
    return weights, offset


def fit_rows(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 30) -> Model:
    """A model from feature rows and labels 0/1.  Without rows, or with one class only, it gives a constant."""
    signs = np.where(np.array(labels, dtype=np.int64) > 0, 1, -1) if labels else np.zeros(0, dtype=np.int64)
    if len(set(signs.tolist())) < 2:
        slope, shift = calibrate(np.zeros(len(signs)), signs)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, slope, shift)

    def fit(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        chosen = [rows[i] for i in part.tolist()]
        ratio = log_ratios(chosen, signs[part])
        scaled = [ratio[r] / max(1e-12, np.linalg.norm(ratio[r])) for r in chosen]
        return ratio, *fit_hinge(chosen, scaled, signs[part], cost, epochs)

    margins, third = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for k in range(3):
        if len(set(signs[third != k].tolist())) == 2:
            held = Model(*fit(np.flatnonzero(third != k)), 1.0, 0.0)
            for i in np.flatnonzero(third == k).tolist():
                margins[i] = held.margin(rows[i])
    return Model(*fit(np.arange(len(rows))), *calibrate(margins, signs))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``most`` labelled rows; their features are made on the executors and sent here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = [f.tobytes() for f in features(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(found, pa.binary())], names=["key", "label", "found"])

    sample = labelled_sample(docs, labels, label, train, most, key, text)
    kind = dict(sample.dtypes)["key"]
    rows = sorted(sample.select("key", "label", "text").mapInArrow(run, f"key {kind}, label int, found binary").collect())
    return fit_rows([np.frombuffer(r["found"], dtype=np.int32) for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of label 1, of every whole text.

    Null and empty texts have no features and get the model's constant.  A column of that name is replaced.
    """
    docs = docs.drop("score")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.probability(f) for f in features(part.column(text).to_pylist())]
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])

        return one

    return map_slices(docs, make, schema, text)

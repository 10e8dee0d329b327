"""A toxicity classifier that is held steady under swaps of identity terms.

Features are indicators of whole lower-case words and of their beginnings and ends.  The features that tell the
classes of the labelled texts apart best are kept; logistic weights are fitted to them.  Counterfactuals of every labelled text
are made: each identity term in it is replaced by others of its group, and a text without such a term gets a neutral mention of one.
The squared changes of the score are part of the loss, so a mention of a group does not raise a score.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import map_slices, sliced
from corpusflow.llm.samples import labelled_sample, sigmoid
from corpusflow.session import materialize

#: Groups of terms that may stand for each other without making a text more or less toxic (English, French, German,
#: Spanish).
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres", "hétérosexuels"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("africains", "européens", "américains", "mexicains", "chinois", "indiens"),
    ("immigrés", "réfugiés", "citoyens"),
    ("vieux", "jeunes", "aveugles", "sourds", "handicapés"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("schwule", "lesben", "bisexuelle", "transgeschlechtliche", "heterosexuelle"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinesen", "inder"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("alte", "junge", "blinde", "gehörlose", "behinderte"),
    ("mujeres", "hombres"),
    ("niñas", "niños"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales", "heterosexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("africanos", "europeos", "americanos", "mexicanos", "chinos", "indios"),
    ("inmigrantes", "refugiados", "ciudadanos"),
    ("viejos", "jóvenes", "ciegos", "sordos", "discapacitados"),
)
#: Counterfactuals of a text.
COUNTERFACTUALS = 3
#: Labelled rows that a fit uses at most, and features that a model keeps at most (both are parameters of ``fit``).
MOST_ROWS = 10_000
MOST_FEATURES = 4000
#: Words whose features a task keeps at most before it starts afresh.
KEPT_WORDS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def word_features(word: str) -> list[str]:
    """The word itself, its beginnings of three to six letters, its end of four."""
    return [f"={word}", *[f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n], *([f"{word[-4:]}$"] if len(word) >= 4 else [])]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def others() -> dict[str, list[str]]:
    """Each identity term with the others of its groups."""
    found: dict[str, list[str]] = {}
    for group in IDENTITY_TERMS:
        for term in group:
            found.setdefault(term, []).extend(o for o in group if o != term and o not in found.get(term, []))
    return found


def counterfactuals(words: set[str], change: dict[str, list[str]], most: int = COUNTERFACTUALS) -> list[set[str]]:
    """The words with their identity terms exchanged, in ``most`` ways at most; without such terms, with one mentioned.

    Which ones is decided by a checksum of the words, so it is the same in every run.
    """
    draw = random.Random(zlib.crc32(" ".join(sorted(words)).encode()))
    mentioned = sorted(w for w in words if w in change)
    if not mentioned:
        return [words | {term} for term in draw.sample(sorted(change), most)]
    turns = {w: draw.sample(change[w], len(change[w])) for w in mentioned}
    found = []
    for turn in range(min(most, max(map(len, turns.values())))):
        swapped = {turns[w][turn % len(turns[w])] for w in mentioned} | words.difference(mentioned)
        if swapped not in found:
            found.append(swapped)
    return found


@dataclass
class Model:
    """Weights by feature, and the offset."""

    weights: dict[str, float] = field(default_factory=dict)
    offset: float = 0.0

    def word_numbers(self) -> tuple[Callable[[str], tuple[int, ...]], np.ndarray]:
        numbers = {f: i for i, f in enumerate(self.weights)}
        return lambda word: tuple(numbers[f] for f in word_features(word) if f in numbers), np.array(list(self.weights.values()), dtype=np.float64)


def fit_weights(
    rows: list[list[int]], swapped: list[list[list[int]]], labels: np.ndarray, size: int, ridge: float = 0.1, steady: float = 1.0, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Minimise logistic loss + ridge + ``steady`` x squared score change, summed over counterfactuals (gradient steps with momentum).

    ``swapped[i]`` holds the features of each of row i's counterfactuals.
    """
    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], dtype=np.int64)

    owner, column = matrix(rows)
    # The change of the features, +1 where the swap adds one and -1 where it takes one away.
    pairs = [(set(r), set(s)) for r, others in zip(rows, swapped) for s in others]
    pairs = [(r, s) for r, s in pairs if r != s]
    plus, minus = matrix([sorted(s - r) for r, s in pairs]), matrix([sorted(r - s) for r, s in pairs])
    n = len(rows)
    weights, offset = np.zeros(size), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    speed, speed_offset = np.zeros(size), 0.0
    # A step that suits each feature's share of rows keeps the descent stable.
    heavy = np.bincount(column, minlength=size).astype(float)
    width = max(1.0, float(np.mean([len(r) for r in rows])) if rows else 1.0)
    rate = 1.0 / (0.25 * heavy * width + ridge + steady * (np.bincount(plus[1], minlength=size) + np.bincount(minus[1], minlength=size)) * width)
    for _ in range(steps):
        p = sigmoid(np.bincount(owner, weights[column], minlength=n) + offset)
        error = p - labels
        gradient = np.bincount(column, error[owner], minlength=size) + ridge * weights
        change = np.bincount(plus[0], weights[plus[1]], minlength=len(pairs)) - np.bincount(minus[0], weights[minus[1]], minlength=len(pairs))
        gradient += steady * (np.bincount(plus[1], change[plus[0]], minlength=size) - np.bincount(minus[1], change[minus[0]], minlength=size))
        speed = 0.9 * speed - rate * gradient
        speed_offset = 0.9 * speed_offset - error.sum() / (0.25 * n * width)
        weights += speed
        offset += speed_offset
    return weights, offset


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text", steady: float = 1.0, features: int = MOST_FEATURES) -> Model:
    """Fit at most ``features`` weights on at most ``most`` labelled rows.

    Feature counts by class are made in the tasks, summed by Spark and ranked there; only the features kept and the
    rows' numbers of them come here.  Without rows of both classes the model is a constant.
    """
    sample = labelled_sample(docs, labels, label, train, most, key, text).select("label", "text")
    sample = materialize(sample, "toxic-sample")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, float(np.log((n_toxic + 1) / (n_clean + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for part in sliced(batches):
            for one, value in zip(part.column("label").to_pylist(), part.column("text").to_pylist()):
                seen[one].update(text_features(set(words_of(value))))
        names = list(seen[1] | seen[0])
        columns = [pa.array(names, pa.string()), *[pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0)]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

    counts = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Ranked by G squared; the constant terms of the two classes do not change the order but keep it exact.
    total = n_toxic + n_clean
    having = F.col("toxic") + F.col("clean")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    score = (
        part(F.col("toxic"), having * n_toxic / total)
        + part(F.col("clean"), having * n_clean / total)
        + part(n_toxic - F.col("toxic"), (total - having) * n_toxic / total)
        + part(n_clean - F.col("clean"), (total - having) * n_clean / total)
    )
    terms = sorted({f for term in others() for f in word_features(term)})
    # Only features that lean towards toxic texts tell one; those of identity terms are there so that mentions of them can be felt.
    leaning = (F.col("gain") > 3.0) & (F.col("toxic") * total > having * n_toxic)
    told = counts.filter(having >= 3).withColumn("gain", score).filter(leaning | F.col("feature").isin(terms))
    kept = [r["feature"] for r in told.orderBy(F.desc("gain"), "feature").limit(features).collect()]
    numbers, change = {f: i for i, f in enumerate(kept)}, others()

    def numbered(words: set[str]) -> list[int]:
        return sorted(numbers[f] for f in text_features(words) if f in numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            rows, swapped = [], []
            for value in part.column("text").to_pylist():
                words = set(words_of(value))
                rows.append(numbered(words))
                swapped.append([numbered(other) for other in counterfactuals(words, change)])
            lists = [pa.array(rows, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([part.column("label"), *lists], names=["label", "found", "swapped"])

    data = sorted(sample.mapInArrow(number, "label int, found array<int>, swapped array<array<int>>").collect())
    labels_seen = np.array([r["label"] for r in data], dtype=np.float64)
    weights, offset = fit_weights([r["found"] for r in data], [r["swapped"] for r in data], labels_seen, len(kept), steady=steady)
    return Model(dict(zip(kept, weights.tolist())), offset)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of label 1, of every whole text.

    Null and empty texts have no features and get the model's constant.  A column of that name is replaced.
    """
    docs = docs.drop("score")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        numbers_of, weights = model.word_numbers()
        known: dict[str, tuple[int, ...]] = {}

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = [set(words_of(t)) for t in part.column(text).to_pylist()]
            if len(known) > KEPT_WORDS:
                known.clear()
            for word in set().union(*lists).difference(known):
                known[word] = numbers_of(word)
            found = [set().union(*map(known.__getitem__, x)) for x in lists]
            sums = np.array([weights[list(f)].sum() if f else 0.0 for f in found]) + model.offset
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(sums), pa.float64())], names=[*part.schema.names, "score"])

        return one

    return map_slices(docs, make, schema, text)


def steadiness(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """How mentions change scores: ``key, score, change, raised`` for every text.

    ``change`` is the mean absolute change of the score over the text's counterfactuals; ``raised`` says whether one of them is
    flagged (score of ``least`` or more) while the text is not: a false positive that a mention alone makes.
    """
    kind = dict(docs.dtypes)[key]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        numbers_of, weights = model.word_numbers()
        change = others()

        def scores(lists: list[set[str]]) -> np.ndarray:
            found = [set().union(*map(numbers_of, words)) for words in lists]
            return sigmoid(np.array([weights[list(f)].sum() if f else 0.0 for f in found]) + model.offset)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            words = [set(words_of(t)) for t in part.column(text).to_pylist()]
            own, told = scores(words), [scores(counterfactuals(w, change)) for w in words]
            changed = [float(np.abs(t - o).mean()) for t, o in zip(told, own)]
            raised = [bool(o < least <= t.max()) for t, o in zip(told, own)]
            return pa.RecordBatch.from_arrays([part.column(key), pa.array(own), pa.array(changed, pa.float64()), pa.array(raised, pa.bool_())], names=[key, "score", "change", "raised"])

        return one

    return map_slices(docs.select(key, text), make, f"`{key}` {kind}, score double, change double, raised boolean", text)

"""Language identification by a linear-chain conditional random field over words.

Each word gets a score per language from letter n-grams of the word between boundary marks (those that touch a mark
are its affixes) and from a lexicon of words seen in training; learned transitions tie neighbouring words
together.  Forward-backward gives every word its distribution over languages, so text that switches between languages
is labelled word by word; a document's language is the one with the largest mean over its words with letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import map_slices, sliced
from corpusflow.session import materialize

#: Labelled rows that a fit uses at most per language, stretches per row, words per stretch.
MOST_ROWS = 400
STRETCHES = 4
STRETCH_WORDS = 30
#: Hashed letter n-grams.
BITS = 16
#: Words of the lexicon, for each language.
LEXICON_WORDS = 20_000
#: Words whose scores a task keeps at most before it starts afresh.
KEPT_WORDS = 300_000
#: Word scores that a fit's forward-backward handles at a time.
FIT_CELLS = 4_000_000
#: Words that forward-backward handles in lockstep.
BLOCK = 64
MARKS = ".,;:!?()[]{}<>\"'|*#$%&/\\-_=+~^`@…«»“”„’‘—–"
UNKNOWN = "und"


def plain(token: str) -> str:
    """The token's letters in lower case; empty if it has none."""
    word = token.strip(MARKS).lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def ngram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (two to four bytes) of all words between marks: the word's number, and the code, of each."""
    raw = [b"\1" + w.encode() + b"\2" for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # bytes to the end of the word
    two = (data[:-3] << 8) | data[1:-2]
    three = (two << 8) | data[2:-1]
    four = (three << 8) | data[3:]
    owners, codes = [], []
    for n, gram, salt in ((2, two, 0x3000017), (3, three, 0x500002B), (4, four, 0x7000035)):
        whole = left >= n
        owners.append(owner[whole])
        mixed = (gram[whole] + np.uint32(salt)) * np.uint32(2654435761)
        codes.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS))
    return np.concatenate(owners), np.concatenate(codes).astype(np.int64)


@dataclass
class Model:
    """Languages, weights of n-grams and lexicon words (rows) by language (columns), transition weights, which n-grams were seen."""

    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    words: np.ndarray
    moves: np.ndarray
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, dtype=bool))

    def scores(self, words: list[str]) -> np.ndarray:
        """One row of scores per word; zeros for a word without letters."""
        return self.scores_and_shares(words)[0]

    def scores_and_shares(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the share of each word's n-grams that some word of the fit had."""
        owner, code = ngram_codes(words)
        counts = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        sums = np.stack([np.bincount(owner, self.grams[code, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        rows = np.fromiter((self.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = sums / np.sqrt(counts)[:, None] + np.where(rows[:, None] >= 0, self.words[rows], 0.0)
        out[[not w for w in words]] = 0.0
        return out, np.bincount(owner, self.seen[code], minlength=len(words)) / counts


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences that lie one after the other in ``scores``; one distribution per word.

    Sequences are cut into blocks.  The product of a block's steps is found for all blocks in lockstep, messages are
    carried from block to block, and then through the words of all blocks in lockstep; the result is exact.
    A sequence starts as if any language came before it.
    """
    total, k = scores.shape
    if not total:
        return scores.copy()
    step = np.exp(moves - moves.max())
    blocks = -(-lengths // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    first_word = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(lengths)), blocks)
    begin = first_word[owner] + (np.arange(len(owner)) - first_block[owner]) * BLOCK
    size = np.minimum(BLOCK, first_word[owner] + lengths[owner] - begin)
    order = np.argsort(-size, kind="stable")  # full blocks first: at each place only a leading part is still going on
    begin, size = begin[order], size[order]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    going = [int((size > j).sum()) for j in range(BLOCK)]
    gain = np.exp(scores - scores.max(axis=1, keepdims=True))

    product = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for j in range(BLOCK):
        n = going[j]
        if not n:
            break
        now = product[:n] @ step * gain[begin[:n] + j][:, None, :]
        product[:n] = now / now.max(axis=(1, 2), keepdims=True)
    product = product[rank]  # back in the order of the text

    ahead, behind = np.full((len(owner), k), 1.0 / k), np.full((len(owner), k), 1.0 / k)
    long_first = np.argsort(-blocks, kind="stable")
    count = blocks[long_first]
    for j in range(1, int(blocks.max(initial=0))):
        at = first_block[long_first[: int((count > j).sum())]] + j
        message = np.einsum("nk,nkl->nl", ahead[at - 1], product[at - 1])
        ahead[at] = message / message.sum(axis=1, keepdims=True)
        last = first_block[long_first[: len(at)]] + count[: len(at)] - 1 - j
        message = np.einsum("nkl,nl->nk", product[last + 1], behind[last + 1])
        behind[last] = message / message.sum(axis=1, keepdims=True)

    ahead, behind = ahead[order], behind[order]
    forward = np.empty_like(gain)
    for j in range(BLOCK):
        n = going[j]
        if not n:
            break
        message = ahead[:n] @ step * gain[begin[:n] + j]
        ahead[:n] = message / message.sum(axis=1, keepdims=True)
        forward[begin[:n] + j] = ahead[:n]
    for j in reversed(range(BLOCK)):
        n = going[j]
        if not n:
            continue
        forward[begin[:n] + j] *= behind[:n]
        message = (gain[begin[:n] + j] * behind[:n]) @ step.T
        behind[:n] = message / message.sum(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


def _pair_counts(scores: np.ndarray, moves: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected transitions of sequences of one length."""
    k = scores.shape[1]
    gain = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, width, k)
    step = np.exp(moves - moves.max())
    ahead, behind = np.empty_like(gain), np.empty_like(gain)
    message = np.full((len(gain), k), 1.0 / k)
    for t in range(width):
        message = message @ step * gain[:, t]
        message /= message.sum(axis=1, keepdims=True)
        ahead[:, t] = message
    message = np.full((len(gain), k), 1.0 / k)
    for t in reversed(range(width)):
        behind[:, t] = message
        message = (gain[:, t] * message) @ step.T
        message /= message.sum(axis=1, keepdims=True)
    posterior = ahead * behind
    posterior /= posterior.sum(axis=2, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(1, width):
        left, right = ahead[:, t - 1], gain[:, t] * behind[:, t]
        expected += step * ((left / ((left @ step) * right).sum(axis=1, keepdims=True)).T @ right)
    return posterior.reshape(-1, k), expected


def fit_stretches(stretches: list[tuple[str, list[str]]], rounds: int = 50, rate: float = 0.3, ridge: float = 1e-4, width: int = 24, lexicon_words: int = LEXICON_WORDS) -> Model:
    """Fit to (language, words) stretches; the lexicon holds up to ``lexicon_words`` words for each language.

    Training sequences of ``width`` words are dealt from the stretches in a fixed mixed order, so that many switch
    language inside; the transitions learnt are those of code-switched text.  Gradients are exact (expected minus
    seen); steps are scaled by each weight's own history.
    """
    known = {language: i for i, language in enumerate(sorted({language for language, _ in stretches}))}
    chosen = [(known[language], words) for language, words in stretches if words]
    k = len(known)
    if not k:
        return Model([], np.zeros((1 << BITS, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)))
    turn = np.random.default_rng(5).permutation(len(chosen))
    flat = [w for i in turn.tolist() for w in chosen[i][1]]
    truth = np.array([chosen[i][0] for i in turn.tolist() for _ in chosen[i][1]], dtype=np.int64)
    n = len(flat) // width * width
    if not n:
        flat, truth, n = (flat * width)[:width], np.resize(truth, width), width
    flat, truth = flat[:n], truth[:n]
    counts = Counter(flat)
    lexicon = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lexicon_words * k]) if c >= 3}
    kinds = {w: i for i, w in enumerate(counts)}
    kind = np.fromiter((kinds[w] for w in flat), dtype=np.int64, count=n)
    model = Model(sorted(known), np.zeros((1 << BITS, k)), lexicon, np.zeros((max(1, len(lexicon)), k)), np.zeros((k, k)))
    owner, code = ngram_codes(list(kinds))
    model.seen[code] = True
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(kinds)), 1))
    rows = np.fromiter((lexicon.get(w, -1) for w in kinds), dtype=np.int64, count=len(kinds))
    seen_moves = np.zeros((k, k))
    inside = np.arange(n) % width > 0
    some = max(1, FIT_CELLS // (k * width)) * width
    np.add.at(seen_moves, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
    history = [np.full_like(p, 1e-8) for p in (model.grams, model.words, model.moves)]
    for _ in range(rounds):
        by_kind = model.scores(list(kinds))
        error, expected = np.zeros((len(kinds), k)), np.zeros((k, k))
        for at in range(0, n, some):  # whole sequences
            here, right = kind[at : at + some], truth[at : at + some]
            posterior, moved = _pair_counts(by_kind[here], model.moves, width)
            posterior[np.arange(len(here)), right] -= 1.0
            error += np.stack([np.bincount(here, posterior[:, j], minlength=len(kinds)) for j in range(k)], axis=1)
            expected += moved
        error /= n
        grams = np.stack([np.bincount(code, (error[:, j] * scale)[owner], minlength=1 << BITS) for j in range(k)], axis=1)
        words = np.zeros_like(model.words)
        words[rows[rows >= 0]] = error[rows >= 0]
        for weights, gradient, past in zip((model.grams, model.words, model.moves), (grams, words, (expected - seen_moves) / n), history):
            gradient = gradient + ridge * weights / n
            past += gradient * gradient
            weights -= rate * gradient / np.sqrt(past)
    return model


def fit(docs: DataFrame, train: Column, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text", language: str = "lang", stretches: int = STRETCHES, stretch_words: int = STRETCH_WORDS) -> Model:
    """Fit on at most ``most`` rows per language, chosen by a hash of the key among those that ``train`` admits.

    Every language that such a row names can be predicted.  Of each row at most ``stretches`` stretches of
    ``stretch_words`` words, spread over the whole text, come here; the other words of long texts are not learnt from.  Of rows
    that share a key and a language the one whose text has the smallest hash counts.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(language).alias("lang"), F.col(text).alias("text"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & F.col("text").isNotNull()).filter(train)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit(23)), "key")
    picked = usable.select("key", "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    chosen = materialize(picked.select("key").distinct(), "langid-rows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            keys, languages, pieces = [], [], []
            for one, name, value in zip(part.column("key").to_pylist(), part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words = [w for w in map(plain, value.split()) if w]
                starts = range(0, len(words), max(stretch_words, len(words) // stretches))
                for start in list(starts)[:stretches]:
                    keys.append(one)
                    languages.append(name)
                    pieces.append(" ".join(words[start : start + stretch_words]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, part.column("key").type), pa.array(languages, pa.string()), pa.array(pieces, pa.string())], names=["key", "lang", "words"]
            )

    kind = dict(rows.dtypes)["key"]
    found = usable.join(F.broadcast(chosen), "key", "left_semi")
    one = found.groupBy("key", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    sent = one.select("key", "lang", F.col("first.text").alias("text")).mapInArrow(cut, f"key {kind}, lang string, words string")
    return fit_stretches([(r["lang"], r["words"].split(" ")) for r in sorted(sent.collect())])


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``lang_pred``, ``score``, ``familiar``, ``spans`` (first and last word, language) of every whole text.

    Words are runs between white space and count from 0; ``score`` is the mean probability of ``lang_pred`` over the
    words with letters, ``familiar`` the mean share of their n-grams that the fit has seen, low for what is no language it knows.
    A null text, a text without letters, and any text under a model without languages give
    ``und``, 0.0 and no spans.  Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "familiar", "spans")
    result = "lang_pred string, score double, familiar double, spans array<struct<first:int,last:int,lang:string>>"
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", {result}"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        k = len(model.languages)
        known: dict[str, int] = {}
        table, lettered, shares = np.zeros((0, k)), np.zeros(0, dtype=bool), np.zeros(0)
        names = np.array([*model.languages, UNKNOWN], dtype=object)

        def learn(new: list[str]) -> None:
            nonlocal table, lettered, shares
            words = [plain(w) for w in new]
            known.update(zip(new, range(len(table), len(table) + len(new))))
            scores, seen = model.scores_and_shares(words)
            table, shares = np.concatenate([table, scores]), np.concatenate([shares, seen])
            lettered = np.concatenate([lettered, np.fromiter(map(bool, words), dtype=bool, count=len(words))])

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal table, lettered, shares
            lists = [(t or "").split() if k else [] for t in part.column(text).to_pylist()]
            if len(known) > KEPT_WORDS:
                known.clear()
                table, lettered, shares = np.zeros((0, k)), np.zeros(0, dtype=bool), np.zeros(0)
            new = list(set().union(*lists).difference(known))
            if new:
                learn(new)
            lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            kind = np.fromiter((known[w] for words in lists for w in words), dtype=np.int64, count=int(lengths.sum()))
            full = np.flatnonzero(lengths)
            owner = np.repeat(np.arange(len(lists)), lengths)
            posterior = posteriors(table[kind], lengths[full], model.moves) if len(kind) else np.zeros((0, k))
            weight = lettered[kind].astype(float) if len(kind) else np.zeros(0)
            words = np.bincount(owner, weight, minlength=len(lists))
            sums = np.stack([np.bincount(owner, posterior[:, j] * weight, minlength=len(lists)) for j in range(k)], axis=1) if k else np.zeros((len(lists), 1))
            means = sums / np.maximum(words, 1)[:, None]
            best = np.where(words > 0, means.argmax(axis=1), k)
            score = np.where(words > 0, np.clip(means.max(axis=1), 0.0, 1.0), 0.0)
            familiar = np.bincount(owner, shares[kind] * weight, minlength=len(lists)) / np.maximum(words, 1) if len(kind) else np.zeros(len(lists))
            # Spans: runs of one most likely language inside a text that has letters.
            use = words[owner] > 0
            which = posterior.argmax(axis=1) if len(kind) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(kind)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            starts = np.flatnonzero(use & ((place == 0) | np.concatenate(([True], which[1:] != which[:-1]))[: len(kind)])) if len(kind) else np.zeros(0, dtype=np.int64)
            held = owner[starts]
            ends = np.concatenate([starts[1:], [len(kind)]])[: len(starts)]
            last = np.where(np.concatenate([held[1:], [-1]])[: len(held)] == held, place[ends - 1] if len(starts) else 0, lengths[held] - 1) if len(starts) else starts
            offsets = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=len(lists))))).astype(np.int32)
            span = pa.StructArray.from_arrays(
                [pa.array(place[starts], pa.int32()), pa.array(last, pa.int32()), pa.array(names[which[starts]].tolist() if len(starts) else [], pa.string())], names=["first", "last", "lang"]
            )
            columns = [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(familiar, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), span)]
            return pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "lang_pred", "score", "familiar", "spans"])

        return one

    return map_slices(docs, make, schema, text)

"""BPE encoding and decoding: speculate with greedy longest matches, verify adjacent pairs, merge the rest exactly.

A sequence of tokens is the BPE encoding of a word exactly if every token encodes its own letters and every
adjacent pair of tokens is *compatible*: encoding the two tokens' letters together gives these two tokens back.
So a word is first cut greedily into the longest tokens, all adjacent pairs of a slice's new words are tested
at once with array operations, and only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusflow.llm import pretoken
from corpusflow.llm.common import map_slices, sliced

#: Words whose ids a task keeps at most before it starts afresh.
KEPT_WORDS = 400_000


class WordBpe:
    """The merges of one tokenizer file whose words end in a suffix (the file's ``end_of_word_suffix``)."""

    def __init__(self, path: str):
        file = pretoken.spec(path)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.letters = pretoken.byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = len(self.ids) - len(merges)
        left = np.array([self.ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in merges], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], dtype=np.int64)
        if not np.array_equal(made, np.arange(self.base, self.base + len(merges))) or not (np.maximum(left, right) < made).all():
            raise ValueError("the file's ids must follow the order of its merges")
        self.merged = dict(zip(zip(left.tolist(), right.tolist()), made.tolist()))
        size = len(self.ids)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.left[made], self.right[made] = left, right
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.longest = max(map(len, self.ids))
        self.sound = self._sound(left, right, made, size)
        self.names: dict[int, str] = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in file["added_tokens"]}

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge into; a number above all ids if none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """For pairs of tokens: does no merge cross the border between them while they are being built?

        The pair is taken apart in the reverse order of its merges.  At each moment the pieces that touch
        the border are known, and so is the next merge that changes either; a merge across the border that
        comes before both breaks the pair.  On equal merges the one further left comes first.
        ``inside`` leaves out the finished pair itself.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        next_x, next_y = np.full(len(x), 1 << 41), np.full(len(x), 1 << 41)
        good, alive, first = np.ones(len(x), dtype=bool), np.arange(len(x)), inside
        while len(alive):
            if not first:
                across = self._lookup(x, y)
                crossed = (across < 1 << 40) & (across < next_x) & (across <= next_y)
                good[alive[crossed]] = False
                stay = ~crossed & ((x >= self.base) | (y >= self.base))
                x, y, next_x, next_y, alive = x[stay], y[stay], next_x[stay], next_y[stay], alive[stay]
            else:
                stay = (x >= self.base) | (y >= self.base)
                x, y, next_x, next_y, alive = x[stay], y[stay], next_x[stay], next_y[stay], alive[stay]
            first = False
            undo_y = (y >= self.base) & (y >= x)
            next_x, next_y = np.where(undo_y, next_x, x), np.where(undo_y, y, next_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return good

    def _sound(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, size: int) -> np.ndarray:
        """Which tokens encode their own letters."""
        sound = np.ones(size, dtype=bool)
        sound[made] = self.compatible(left, right, inside=True)
        for token in made[~sound[made]].tolist():  # whatever is built from such a token is not sound either
            broken = {token}
            while broken:
                hit = made[np.isin(left, list(broken)) | np.isin(right, list(broken))]
                broken = set(hit[sound[hit]].tolist())
                sound[list(broken)] = False
        return sound

    def spelled(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])

    def greedy(self, spelled: str) -> list[int]:
        """Longest tokens from the left; the last one must carry the suffix."""
        ids, suffix, at, end, found = self.ids, self.suffix, 0, len(spelled), []
        while at < end:
            for to in range(min(end, at + self.longest), at, -1):
                token = ids.get(spelled[at:to] + suffix if to == end else spelled[at:to])
                if token is not None:
                    found.append(token)
                    at = to
                    break
        return found

    def exact(self, spelled: str) -> list[int]:
        """The merges in order, one at a time, leftmost first."""
        tokens = [self.ids[c] for c in spelled[:-1]] + [self.ids[spelled[-1] + self.suffix]]
        while len(tokens) > 1:
            options = [self.merged.get(p, 1 << 40) for p in zip(tokens, tokens[1:])]
            best = min(options)
            if best == 1 << 40:
                break
            at = options.index(best)
            tokens[at : at + 2] = [best]
        return tokens

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        spelled = [self.spelled(w) for w in words]
        guess = [self.greedy(s) for s in spelled]
        counts = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        failed = np.zeros(len(guess), dtype=bool)
        failed[owner[~self.sound[flat]]] = True
        inner = owner[1:] == owner[:-1]
        pairs, place = np.unique((flat[:-1][inner] << 32) | flat[1:][inner], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed[owner[1:][inner][~fits[place]]] = True
        for i in np.flatnonzero(failed).tolist():
            guess[i] = self.exact(spelled[i])
        return guess


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every whole text: ``key``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit).

    Null and empty texts have no tokens.  Special tokens inside a text keep their ids.  A null key stays null;
    every row is encoded, repeated rows too; other columns are ignored.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        bpe, known, special = WordBpe(path), {}, pretoken.specials(path)
        library = Tokenizer.from_file(path)
        words_of = regex.compile(pretoken.spec(path)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        fixed = {name: np.uint32(i).tobytes() for name, i in bpe.added.items()}

        def split(value: str) -> list[str] | np.ndarray:
            if not pretoken.settled(value):
                return np.array(library.encode(value, add_special_tokens=False).ids, dtype="<u4")
            if special and "<|" in value:
                parts = special.split(value)
                return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else words_of(pretoken.lowered(part)))]
            return words_of(pretoken.lowered(value))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = [split(t) if t else [] for t in part.column("text").to_pylist()]
            if len(known) > KEPT_WORDS:
                known.clear()
            known.update(fixed)
            new = list(set().union(*[x for x in lists if isinstance(x, list)]).difference(known))
            for word, found in zip(new, bpe.encode_words(new)):
                known[word] = np.array(found, dtype="<u4").tobytes()
            get = known.__getitem__
            ids = [b"".join(map(get, x)) if isinstance(x, list) else x.tobytes() for x in lists]
            return pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[key, "n_tokens", "ids"],
            )

        return one

    kind = dict(docs.dtypes)[key]
    return map_slices(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"), make, f"`{key}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """The texts that ids stand for, special tokens kept: all columns, and ``decoded``.

    The file names no decoder, so its tokens are joined by blanks.  Ids that the file lacks are left out.
    Null ids decode to null.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = pretoken.spec(path)
        names = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        table = [names.get(i) for i in range(max(names) + 1)]
        whole = None not in table

        def text_of(value: bytes | None) -> str | None:
            if value is None:
                return None
            ids = np.frombuffer(value, dtype="<u4").tolist()
            if whole and max(ids, default=0) < len(table):
                return " ".join(map(table.__getitem__, ids))
            return " ".join([names[i] for i in ids if i in names])

        for part in sliced(batches, "ids"):
            decoded = pa.array(map(text_of, part.column("ids").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)

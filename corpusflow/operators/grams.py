"""Exact search for many patterns in a batch of texts by hashed grams.

Each pattern is filed under one of its grams, the one that fewest patterns share.  The texts of a batch are one array of letters, whose
gram hashes are computed for all positions at once; a bitmap drops the positions that no pattern's gram can stand at, a sorted
table names the patterns for the few that are left, and these are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Gram widths; a pattern is filed under the largest it is long enough for.
WIDTHS = (1, 2, 4, 8)
#: Bits of a bitmap's address.
BITS = 20
#: Positions hashed at a time, and letters compared at a time.
POSITIONS, COMPARED = 1_000_000, 1_000_000

_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def letters_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (with the end at last)."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return letters, np.cumsum([0, *map(len, texts)])


def gram_hashes(letters: np.ndarray, widths: Sequence[int]) -> dict[int, np.ndarray]:
    """The hash of the gram that begins at each position, for each width; each width comes from the one half as wide."""
    hashes, found, width = letters.astype(np.uint64) + np.uint64(1), {}, 1
    for i, odd in enumerate(_ODD):
        if width in widths:
            mixed = hashes * _ODD[-1]
            found[width] = mixed ^ (mixed >> np.uint64(31))
        if width >= max(widths, default=0) or len(hashes) <= width:
            break
        hashes = hashes[:-width] * odd + hashes[width:]
        width *= 2
    return found


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _ODD[1]) >> np.uint64(64 - BITS)


class GramTable:
    """Patterns filed under their grams."""

    def __init__(self, patterns: Sequence[str]):
        self.letters, self.starts = letters_of(patterns)
        self.lengths = np.diff(self.starts)
        widths = np.select([self.lengths >= w for w in reversed(WIDTHS)], list(reversed(WIDTHS)), 0)
        self.widths = [w for w in WIDTHS if (widths == w).any()]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, hashes in gram_hashes(self.letters, self.widths).items():
            # Positions of patterns of this width at which a whole gram stands.
            number = np.flatnonzero(widths == width)
            count = self.lengths[number] - width + 1
            owner = np.repeat(number, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            grams = hashes[self.starts[owner] + at]
            _, same, shared = np.unique(grams, return_inverse=True, return_counts=True)
            order = np.lexsort((at, shared[same], owner))
            first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            first = first[np.argsort(grams[first], kind="stable")]
            bitmap = np.zeros(1 << BITS, dtype=bool)
            bitmap[_cells(grams[first])] = True
            self.tables[width] = grams[first], owner[first], at[first], bitmap

    @classmethod
    def of(cls, arrays: dict) -> GramTable:
        """The table whose ``vars`` these are."""
        table = cls.__new__(cls)
        table.__dict__.update(arrays)
        return table

    def find(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pattern, start) of all occurrences, overlapping ones too, some at a time."""
        letters, starts = letters_of(texts)
        most = max(self.widths, default=1)
        for begin in range(0, len(letters), POSITIONS):
            part = letters[begin : begin + POSITIONS + most - 1]
            for width, hashes in gram_hashes(part, self.widths).items():
                hashes = hashes[:POSITIONS]
                grams, number, at, bitmap = self.tables[width]
                near = np.flatnonzero(bitmap[_cells(hashes)])
                low, high = (np.searchsorted(grams, hashes[near], side) for side in ("left", "right"))
                near, low, count = near[high > low], low[high > low], (high - low)[high > low]
                # Many patterns may share a gram, so as many are taken at a time as fit.
                for some in np.split(np.arange(len(near)), np.flatnonzero(np.diff(np.cumsum(count) // COMPARED)) + 1):
                    if len(some):
                        n = count[some]
                        entry = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        start = begin + np.repeat(near[some], n) - at[entry]
                        yield from self._verified(letters, starts, start, number[entry])

    def _verified(self, letters: np.ndarray, starts: np.ndarray, start: np.ndarray, pattern: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those candidates at which the pattern's letters stand, all in one text."""
        length = self.lengths[pattern]
        text = np.searchsorted(starts, np.maximum(start, 0), "right") - 1
        inside = (start >= 0) & (start + length <= starts[np.minimum(text + 1, len(starts) - 1)])
        start, pattern, length, text = start[inside], pattern[inside], length[inside], text[inside]
        order = np.argsort(length, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if not len(same):
                continue
            width = int(length[same[0]])
            step = max(1, COMPARED // width)
            for i in range(0, len(same), step):
                some = same[i : i + step]
                place = np.arange(width)
                equal = (letters[start[some][:, None] + place] == self.letters[self.starts[pattern[some]][:, None] + place]).all(axis=1)
                kept = some[equal]
                if len(kept):
                    yield text[kept], pattern[kept], start[kept] - starts[text[kept]]

    def counts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, occurrences, first start) of all pairs with an occurrence."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for text, pattern, start in self.find(texts):
            pair = text * len(self.lengths) + pattern
            pairs, place, n = np.unique(pair, return_inverse=True, return_counts=True)
            first = np.full(len(pairs), np.iinfo(np.int64).max)
            np.minimum.at(first, place, start)
            found.append((pairs, n, first))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 4
        pair, n, start = (np.concatenate(column) for column in zip(*found))
        pairs, place = np.unique(pair, return_inverse=True)
        total, first = np.zeros(len(pairs), dtype=np.int64), np.full(len(pairs), np.iinfo(np.int64).max)
        np.add.at(total, place, n)
        np.minimum.at(first, place, start)
        return pairs // len(self.lengths), pairs % len(self.lengths), total, first

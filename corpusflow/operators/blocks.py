"""Scores of requests against postings that are dealt out by chunk: a task adds them up for all requests at once.

The postings of the asked terms travel once, whichever requests ask for them, as (slot, key, tf); a slot is a term, or a term of a
tier.  A task has all postings of its chunks, in order of their keys, sums them in blocks of bounded size, and lets go only of what
can be among a request's best hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Matches (request, posting) added up at a time; cells of a table (chunk, request) at most, beyond which matches are sorted.
MATCHES, CELLS = 1_000_000, 4_000_000
#: Postings that come together before a task adds them up, and hits of a request's best that it holds before it sorts them out.
POSTINGS, HELD = 200_000, 200_000
KINDS = {"must": 0, "should": 1, "must_not": 2}


@dataclass(frozen=True)
class Asked:
    """Clauses by slot (those of slot s from ``starts[s]`` on): request, weight and kind; and for each request its must terms.

    ``wanted`` is the number of hits of each request (none: all qualifying chunks).  ``low`` is the score a request's last
    hit has at least (minus infinity: not known), ``rest`` what its chunks of a tier may still get: columns are tiers from ``tier`` on.
    With ``rarest``, the clause whose postings are a request's candidates, chunks of one key are one, and count as often as that
    clause finds them; chunks without a key are not found.
    """

    starts: np.ndarray
    request: np.ndarray
    weight: np.ndarray
    kind: np.ndarray
    need: np.ndarray
    margin: float
    wanted: np.ndarray | None = None
    low: np.ndarray | None = None
    rest: np.ndarray | None = None
    tier: int = 0
    rarest: np.ndarray | None = None


def asked(slots: Sequence[int], request: Sequence[int], weight: Sequence[float], kind: Sequence[str], need: Sequence[int], margin: float, **more) -> Asked:
    """The clauses in order of their slots."""
    slot = np.asarray(slots, dtype=np.int64)
    order = np.argsort(slot, kind="stable")
    starts = np.searchsorted(slot[order], np.arange(int(slot.max(initial=-1)) + 2))
    if more.get("rarest") is not None:
        more["rarest"] = np.asarray(more["rarest"], dtype=bool)[order]
    kinds = np.asarray([KINDS.get(k, 3) for k in kind], dtype=np.int8)
    return Asked(starts, np.asarray(request, dtype=np.int64)[order], np.asarray(weight, dtype=float)[order], kinds[order], np.asarray(need, dtype=np.int64), margin, **more)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _firsts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a new chunk begins, of rows in order of the keys; null is a value like others."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for name in keys:
        column = rows.column(name).combine_chunks()
        values, null = pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _added(a: Asked, chunk: np.ndarray, slot: np.ndarray, tf: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, request, score) of qualifying chunks from postings, those of a chunk in order of their slots."""
    if a.rarest is not None:
        firsts = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (slot[1:] != slot[:-1]))[: len(slot)])
        times, tf = np.diff(np.append(firsts, len(slot))), np.add.reduceat(tf, firsts) if len(tf) else tf
        chunk, slot = chunk[firsts], slot[firsts]
    n = a.starts[slot + 1] - a.starts[slot]
    entry = np.repeat(a.starts[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    requests = len(a.need)
    pair, kind = np.repeat(chunk, n) * requests + a.request[entry], a.kind[entry]
    part = np.where(kind == KINDS["must_not"], 0.0, np.repeat(tf, n) * a.weight[entry])
    if chunks * requests <= max(CELLS, 4 * len(pair)):
        pairs, place = None, pair
        cells = chunks * requests
    else:
        pairs, place = np.unique(pair, return_inverse=True)
        cells = len(pairs)
    score = np.bincount(place, part, cells)
    must, should, must_not = (np.bincount(place[kind == k], minlength=cells) if (a.kind == k).any() else 0 for k in range(3))
    if a.rarest is not None:
        rare = a.rarest[entry]
        found = np.bincount(place[rare], np.repeat(times, n)[rare], cells)
        score, must, should, must_not = score * found, must * found, should * found, must_not * found
    request = (np.arange(cells) if pairs is None else pairs) % max(1, requests)
    need = a.need[request]
    fits = np.flatnonzero((must == need) & (must_not == 0) & ((need > 0) | (should > 0)))
    pairs = fits if pairs is None else pairs[fits]
    return pairs // max(1, requests), request[fits], score[fits]


def _kth(a: Asked, request: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores of the last wanted hit of each request so far; minus infinity where there are fewer.  Rows in order of request and score."""
    first = np.searchsorted(request, np.arange(len(a.need)))
    last, low = first + a.wanted - 1, np.full(len(a.need), -np.inf)
    there = (a.wanted > 0) & (last < np.append(first[1:], len(request)))
    low[there] = score[last[there]]
    return low


def _able(a: Asked, rows: pa.Table) -> pa.Table:
    """Hits (request, doc_id, offset, tier, score) that can be among the wanted ones of their requests.

    Of equal scores, to the last bit, the wanted number of smallest keys is enough, unless more may be added to them.
    """
    if a.wanted is None:
        return rows
    order = [("request", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("offset", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
    request, score = rows.column("request").to_numpy(), rows.column("score").to_numpy()
    low = _kth(a, request, score)
    if a.low is not None:
        low = np.maximum(low, a.low)
    kept = (a.wanted[request] > 0) & (score + _rest(a, rows) >= low[request] - a.margin)
    if a.rest is None and len(request):
        first = np.flatnonzero(np.append(True, (request[1:] != request[:-1]) | (score[1:] != score[:-1])))
        length = np.diff(np.append(first, len(request)))
        kept &= np.arange(len(request)) - np.repeat(first, length) < a.wanted[request]
    return rows.filter(pa.array(kept))


def _rest(a: Asked, rows: pa.Table) -> np.ndarray | float:
    if a.rest is None:
        return 0.0
    tier = rows.column("tier").to_numpy() - a.tier
    inside = (tier >= 0) & (tier < a.rest.shape[1])
    return np.where(inside, a.rest[rows.column("request").to_numpy(), np.where(inside, tier, 0)], 0.0)


def hits(a: Asked, keys: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(request, *keys, score) from postings (slot, *keys, tf) in order of their keys, all of a chunk in the same task."""

    def added(rows: pa.Table, firsts: np.ndarray) -> Iterator[pa.Table]:
        slot, tf = rows.column("slot").to_numpy(), rows.column("tf").to_numpy().astype(float)
        chunk = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, rows.num_rows)))
        ends = np.cumsum(a.starts[slot + 1] - a.starts[slot])
        part = (ends[firsts] // MATCHES) if len(firsts) else ends
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(firsts)]):
            begin, end = firsts[low], firsts[high] if high < len(firsts) else rows.num_rows
            at, request, score = _added(a, chunk[begin:end] - low, slot[begin:end], tf[begin:end], high - low)
            found = rows.select(keys).take(pa.array(firsts[low:high][at]))
            yield _able(a, found.append_column("request", pa.array(request)).append_column("score", pa.array(score)))

    def blocks() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < POSTINGS:
                continue
            rows = _table(held)
            firsts = _firsts(rows, keys)
            # The last chunk may go on.
            held = rows.slice(int(firsts[-1])).to_batches()
            yield from added(rows.slice(0, int(firsts[-1])), firsts[:-1])
        if held and sum(b.num_rows for b in held):
            rows = _table(held)
            yield from added(rows, _firsts(rows, keys))

    best: list[pa.Table] = []
    new = 0
    for found in blocks():
        if a.wanted is None:
            yield found
            continue
        best.append(found)
        new += found.num_rows
        if new > HELD:
            best, new = [_able(a, pa.concat_tables(best))], 0
    if best:
        yield _able(a, pa.concat_tables(best))

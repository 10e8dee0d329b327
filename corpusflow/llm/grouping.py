"""Packing documents into few sequences by a grouping genetic algorithm on islands.

Documents longer than a window are cut into whole windows and one shorter piece; only the shorter pieces need to share windows.  They
are dealt to groups of bounded size.  A group is evolved on several islands: an individual is a partition of the group's pieces into
windows, a child takes some well-filled windows of one parent whole, loses the other parent's windows that hold the same pieces, and
places what these held best-fit.  Between epochs the islands' best individuals move on to the next island.  Windows that stay
ill-filled at the end are dissolved, and their pieces form the next level's groups, until one group holds all of them.

Only numbers and lengths take part in this; token ids wait in a stored table.
"""

from __future__ import annotations

import json
import random
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import sliced
from corpusflow.llm.packing import byte_encoder
from corpusflow.session import materialize

#: Pieces of a group, about.
GROUP = 2000
#: Islands of a group; epochs between which individuals migrate; generations of an epoch.
ISLANDS, EPOCHS, GENERATIONS = 2, 3, 6
#: Individuals of an island, children of a generation, and individuals that move on.
PEOPLE, CHILDREN, ELITE = 4, 3, 1
#: Share of a parent's well-filled windows that a child takes.
INJECTED = 0.15
#: A window filled less than this share is dissolved for the next level.
WELL = 0.97

PIECE = "piece int, start long, length long, ids binary"
PERSON = "group long, island int, place int, bins int, fitness double, genes binary"


class Bins:
    """An individual: the pieces of each window and how full it is."""

    def __init__(self, bins: list[list[int]], fills: list[int], size: int):
        self.bins, self.fills = bins, fills
        self.fitness = sum(f * f for f in fills) / (size * size * max(1, len(fills)))

    def order(self) -> tuple:
        """Fewer windows first, then the better filled."""
        return len(self.bins), -self.fitness


def best_fit(bins: list[list[int]], fills: list[int], pieces: list[int], lengths: list[int], size: int) -> None:
    """Place the pieces one after another into the window with the least room that is enough, or into a new one."""
    rooms = sorted((size - f, i) for i, f in enumerate(fills) if f < size)
    for piece in pieces:
        need = lengths[piece]
        at = bisect_left(rooms, (need, -1))
        if at < len(rooms):
            room, i = rooms.pop(at)
        else:
            room, i = size, len(bins)
            bins.append([])
            fills.append(0)
        bins[i].append(piece)
        fills[i] += need
        if room > need:
            insort(rooms, (room - need, i))


def fresh(order: list[int], lengths: list[int], size: int) -> Bins:
    bins: list[list[int]] = []
    fills: list[int] = []
    best_fit(bins, fills, order, lengths, size)
    return Bins(bins, fills, size)


def crossed(a: Bins, b: Bins, lengths: list[int], size: int, draw: random.Random) -> Bins:
    """A child of ``a`` with some of the well-filled windows of ``b``."""
    mean = sum(b.fills) / len(b.fills)
    chosen = [i for i, f in enumerate(b.fills) if f >= mean and draw.random() < INJECTED]
    taken = {piece for i in chosen for piece in b.bins[i]}
    bins, fills, displaced = [b.bins[i][:] for i in chosen], [b.fills[i] for i in chosen], []
    for pieces, fill in zip(a.bins, a.fills):
        if taken.isdisjoint(pieces):
            bins.append(pieces[:])
            fills.append(fill)
        else:
            displaced += [piece for piece in pieces if piece not in taken]
    return _placed(bins, fills, displaced, lengths, size, draw)


def mutated(a: Bins, lengths: list[int], size: int, draw: random.Random) -> Bins:
    """The worst-filled windows and a few others are dissolved and their pieces placed anew."""
    worst = sorted(range(len(a.fills)), key=a.fills.__getitem__)[: max(2, len(a.fills) // 50)]
    gone = {*worst, *draw.sample(range(len(a.fills)), min(len(a.fills), 3 + len(a.fills) // 50))}
    bins = [pieces[:] for i, pieces in enumerate(a.bins) if i not in gone]
    fills = [f for i, f in enumerate(a.fills) if i not in gone]
    return _placed(bins, fills, [piece for i in sorted(gone) for piece in a.bins[i]], lengths, size, draw)


def _placed(bins: list[list[int]], fills: list[int], displaced: list[int], lengths: list[int], size: int, draw: random.Random) -> Bins:
    # Longest first, alike lengths in any order.
    draw.shuffle(displaced)
    displaced.sort(key=lengths.__getitem__, reverse=True)
    best_fit(bins, fills, displaced, lengths, size)
    return Bins(bins, fills, size)


def evolve(people: list[Bins], lengths: list[int], size: int, generations: int, draw: random.Random) -> list[Bins]:
    """The island's individuals after some generations, best first; fewer once no better one is possible."""
    least = -(-sum(lengths) // size)
    people = sorted(people, key=Bins.order)[:PEOPLE]
    for _ in range(generations):
        if len(people[0].bins) == least:
            break
        children = []
        for _ in range(CHILDREN):
            # The better of two becomes a parent.
            a, b = (min(draw.sample(people, min(2, len(people))), key=Bins.order) for _ in range(2))
            child = crossed(a, b, lengths, size, draw) if a is not b else a
            children.append(mutated(child, lengths, size, draw))
        people = sorted(people + children, key=Bins.order)[:PEOPLE]
    return people


def first_people(lengths: list[int], size: int, draw: random.Random) -> list[Bins]:
    """One individual by decreasing lengths; the others, if it can be bettered, in any order."""
    order = list(range(len(lengths)))
    people = [fresh(sorted(order, key=lengths.__getitem__, reverse=True), lengths, size)]
    least = -(-sum(lengths) // size)
    while len(people) < PEOPLE and len(people[0].bins) > least:
        draw.shuffle(order)
        people.append(fresh(order, lengths, size))
    return people


def _genes(person: Bins, count: int) -> bytes:
    genes = np.empty(count, dtype="<i4")
    for i, pieces in enumerate(person.bins):
        genes[pieces] = i
    return genes.tobytes()


def _person(genes: bytes, lengths: list[int], size: int) -> Bins:
    of = np.frombuffer(genes, dtype="<i4").tolist()
    bins: list[list[int]] = [[] for _ in range(max(of) + 1)]
    fills = [0] * len(bins)
    for piece, i in enumerate(of):
        bins[i].append(piece)
        fills[i] += lengths[piece]
    return Bins(bins, fills, size)


def _island(size: int, epoch: int, seed: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """One epoch of one island: its individuals and the immigrants evolve; the first epoch makes them."""

    def run(key: tuple, pieces: pa.Table, people: pa.Table) -> pa.Table:
        group, island = (k.as_py() for k in key)
        columns: list[list] = [[] for _ in range(6)]
        if pieces.num_rows:
            lengths = pieces.sort_by("row").column("length").to_pylist()
            draw = random.Random(f"{seed} {group} {island} {epoch}")
            own = [_person(g, lengths, size) for g in people.sort_by([("bins", "ascending"), ("fitness", "descending"), ("place", "ascending")]).column("genes").to_pylist()]
            for place, person in enumerate(evolve(own or first_people(lengths, size, draw), lengths, size, GENERATIONS, draw)):
                row = group, island, place, len(person.bins), person.fitness, _genes(person, len(lengths))
                for column, value in zip(columns, row):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("group", "island", "place", "bins", "fitness", "genes"), columns, kinds)})

    return run


def _decoded(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``row, length, sequence_id, offset, fill`` of a group's pieces under its best individual."""

    def run(pieces: pa.Table, best: pa.Table) -> pa.Table:
        if pieces.num_rows:
            pieces = pieces.sort_by("row")
            rows, lengths = pieces.column("row").to_numpy(), pieces.column("length").to_numpy()
            genes = np.frombuffer(best.column("genes")[0].as_py(), dtype="<i4")
            order = np.lexsort((rows, genes))
            rows, lengths, genes = rows[order], lengths[order], genes[order]
            first = np.flatnonzero(np.diff(genes, prepend=-1))
            owner = np.cumsum(np.diff(genes, prepend=-1) != 0) - 1
            before = np.cumsum(lengths) - lengths
            fills = np.add.reduceat(lengths, first)
            values = rows, lengths, rows[first][owner], before - before[first][owner], fills[owner]
        else:
            values = ([],) * 5
        return pa.table({name: pa.array(v, pa.int64()) for name, v in zip(("row", "length", "sequence_id", "offset", "fill"), values)})

    return run


def _level(pieces: DataFrame, groups: int, level: int, size: int, seed: int) -> DataFrame:
    """The pieces (row, length) of all groups in windows: ``row, length, sequence_id, offset, fill``."""
    dealt = materialize(pieces.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("group")), "groups")
    islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    people = dealt.sparkSession.createDataFrame([], PERSON)
    for epoch in range(EPOCHS):
        met = islands.groupBy("group", "island").cogroup(people.groupBy("group", "island"))
        people = materialize(met.applyInArrow(_island(size, epoch, seed), PERSON), "people")
        moved = people.filter(F.col("place") < ELITE).withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
        if epoch + 1 < EPOCHS:
            people = people.unionByName(moved.withColumn("place", F.col("place") + PEOPLE))
    best = people.groupBy("group").agg(F.min_by("genes", F.struct("bins", (-F.col("fitness")).alias("less"), "island", "place")).alias("genes"))
    return dealt.groupBy("group").cogroup(best.groupBy("group")).applyInArrow(_decoded(size), "row long, length long, sequence_id long, offset long, fill long")


def place(pieces: DataFrame, size: int, group: int = GROUP, seed: int = 1) -> DataFrame:
    """``row, sequence_id, offset`` of all pieces (``row`` unique, ``length`` from 1 to ``size``), in few windows of ``size``.

    A window is numbered by the smallest row in it.  Pieces as long as a window have one of their own.
    """
    whole = pieces.filter(F.col("length") == size).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = pieces.filter(F.col("length") < size).select("row", "length"), 0
    count, placed = rest.count(), whole
    while count:
        groups = -(-count // group)
        found = materialize(_level(rest, groups, level, size, seed), "placed")
        last = groups == 1
        done = found if last else found.filter(F.col("fill") >= WELL * size)
        placed = placed.unionByName(done.select("row", "sequence_id", "offset"))
        if last:
            break
        rest = found.filter(F.col("fill") < WELL * size).select("row", "length")
        left = rest.count()
        # Were nearly all windows ill-filled (pieces over half a window fit with none), more levels would not better them.
        if left > 0.9 * count:
            placed = placed.unionByName(found.filter(F.col("fill") < WELL * size).select("row", "sequence_id", "offset"))
            break
        count, level = left, level + 1
    return placed


@lru_cache
def id_bytes(path: str) -> int:
    """Bytes an id takes while it is stored and moved: two for vocabularies that fit.

    The file is read apart from ``pretoken``, whose tables travel to the tasks with the functions that use them.
    """
    with open(path, encoding="utf-8") as source:
        file = json.load(source)
    return 2 if max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]) < 1 << 16 else 4


def widened(rows: DataFrame) -> DataFrame:
    """The rows with ``ids`` of four bytes instead of two; a batch is one array, so no row is handled alone."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("ids")
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
            data = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view("<u2").astype("<u4")
            wide = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(((ends - ends[0]) * 2).astype(np.int32)), pa.py_buffer(data)])
            yield part.set_column(part.schema.get_field_index("ids"), "ids", wide)

    return rows.mapInArrow(widen, rows.schema)


def cut(docs: DataFrame, path: str, size: int, end_id: int, key: str, text: str) -> DataFrame:
    """``key, piece, start, length, ids``: each document's ids (of ``id_bytes``) and ``end_id``, cut where they are longer than ``size``."""
    kind = dict(docs.dtypes)[key]
    width = id_bytes(path)
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path, width)
        for part in sliced(batches):
            owner, number, start, length, ids = [], [], [], [], []
            for i, own in enumerate(encode(part.column("text").to_pylist())):
                own += end
                tokens = len(own) // width
                begins = [0, *range((tokens - 1) % size + 1, tokens, size)]
                for n, (begin, stop) in enumerate(zip(begins, [*begins[1:], tokens])):
                    owner.append(i)
                    number.append(n)
                    start.append(begin)
                    length.append(stop - begin)
                    ids.append(own[width * begin : width * stop])
            columns = [part.column("key").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64())]
            columns += [pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids"])

    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(pieces, f"key {kind}, {PIECE}")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", group: int = GROUP, seed: int = 1) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` ids as the algorithm finds.

    One row per piece: ``key, piece, start, length, ids, sequence_id, offset``.  ``ids`` is binary (little-endian unsigned 32-bit).
    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone.  Only documents longer than ``size``
    are cut, so that all their pieces but the first are as long as a window.  Every row is packed, repeated rows and null keys too;
    other columns are ignored; no rows give no rows.  The result depends on ``seed`` and on how rows were numbered.
    """
    stored = materialize(cut(docs, path, size, end_id, key, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = materialize(place(stored.select("row", "length"), size, group, seed), "sequences")
    packed = stored.join(placed, "row").drop("row").withColumnRenamed("key", key)
    return widened(packed) if id_bytes(path) == 2 else packed

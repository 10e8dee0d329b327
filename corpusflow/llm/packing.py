"""Packing documents into training sequences with a bounded number of open windows.

Each task reads its documents once.  It cuts a document's ids into whole windows and one remainder, and places
the remainder best-fit into one of a fixed number of open windows.  When none fits, the fullest window is
emitted.  The windows left open at the end of the tasks are merged afterwards, a bounded number of them at a time.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import pretoken
from corpusflow.llm.common import sliced
from corpusflow.session import materialize

#: Words whose ids a task keeps at most before it starts afresh.
KEPT_WORDS = 400_000
#: Tasks (or groups of tasks) whose open windows are merged together.
MERGED_TASKS = 128

PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_encoder(path: str, width: int = 4) -> Callable[[list[str | None]], list[bytes]]:
    """Ids (little-endian unsigned, of ``width`` bytes) of whole texts by a byte-level tokenizer file.

    A task's words repeat, so the ids of each are kept.  New words go to a rank encoder over the same vocabulary
    where the file's ids follow the order of its merges, else to the library.  Texts with special tokens or
    letters that this Unicode version classifies differently go to the library whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    file, special = pretoken.spec(path), pretoken.specials(path)
    vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    base = len(vocabulary) - len(pairs)
    if all(vocabulary[a + b] == base + i for i, (a, b) in enumerate(pairs)):
        byte_of = {letter: b for b, letter in enumerate(pretoken.byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        ranked = tiktoken.Encoding("file", pat_str=pretoken.BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        word_ids = ranked.encode_ordinary
    else:
        word_ids = lambda word: library.encode(word, add_special_tokens=False).ids
    code = "H" if width == 2 else "I"

    class Words(dict):
        """The ids of the words met so far; those of a new word are found when it is first asked for."""

        def __missing__(self, word: str) -> bytes:
            ids = self[word] = array(code, word_ids(word)).tobytes()
            return ids

    known = Words()
    words_of, ascii_words_of = regex.compile(pretoken.BYTE_PATTERN).findall, re.compile(pretoken.ASCII_PATTERN, re.ASCII).findall

    def encode(texts: list[str | None]) -> list[bytes]:
        if len(known) > KEPT_WORDS:
            known.clear()
        get, out = known.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif not pretoken.settled(text) or (special and "<|" in text and special.search(text)):
                out.append(array(code, library.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, (ascii_words_of if text.isascii() else words_of)(text))))
        return out

    return encode


class Windows:
    """At most ``open_windows`` partly filled windows of ``size`` ids; ``emit`` takes a finished one's pieces."""

    def __init__(self, size: int, open_windows: int, slack: int, emit: Callable[[list], None]):
        self.size, self.most, self.slack, self.emit = size, open_windows, slack, emit
        self.rooms: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.pieces: dict[int, list] = {}
        self.made = 0

    def _put(self, room: int, window: int, piece: tuple) -> None:
        self.pieces[window].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.rooms, (room, window))
        else:
            self.emit(self.pieces.pop(window))

    def _open(self, piece: tuple) -> None:
        self.made += 1
        self.pieces[self.made] = []
        self._put(self.size, self.made, piece)

    def place(self, key: object, start: int, ids: bytes, tokens: int) -> None:
        """Place ids (fewer than a window holds, or exactly as many)."""
        need = len(ids) // 4
        at = bisect_left(self.rooms, (need, -1))
        if at < len(self.rooms):  # the least room that is enough
            room, window = self.rooms.pop(at)
            self._put(room, window, (key, start, ids, tokens))
        elif need == self.size or len(self.rooms) < self.most:
            self._open((key, start, ids, tokens))
        else:
            room, window = self.rooms.pop(0)  # none fits: the fullest goes
            if room <= self.slack:
                self.emit(self.pieces.pop(window))
                self._open((key, start, ids, tokens))
            else:  # a document may be cut anywhere, so a wide gap is filled first
                self._put(room, window, (key, start, ids[: 4 * room], tokens))
                self.place(key, start + room, ids[4 * room :], tokens)

    def left(self) -> list[list]:
        """The pieces of the windows still open, fullest first."""
        return [self.pieces[window] for _, window in self.rooms]


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    open_windows: int = 32,
    slack: int = 32,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    One row per piece: ``key, start, length, ids, doc_tokens, sequence_id, offset``.  ``ids`` is binary
    (little-endian unsigned 32-bit), ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's.  A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone.  An emitted
    sequence lacks at most ``slack`` ids, but for the last one of each merge.  Every row is packed, repeated rows and
    null keys too; other columns are ignored; no rows give no rows.
    """
    kind = dict(docs.dtypes)[key]
    source = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    schema = f"key {kind}, {PIECE}, task long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, out = byte_encoder(path), []
        end = np.array([end_id], dtype="<u4").tobytes()
        windows = Windows(size, open_windows, slack, out.append)
        count, key_type = 0, None

        def flush(open_ones: bool) -> pa.RecordBatch:
            nonlocal count
            done, columns = list(out), [[] for _ in range(8)]
            out.clear()
            for pieces in done:
                offset = 0
                for piece_key, start, ids, tokens in pieces:
                    row = (piece_key, start, len(ids) // 4, ids, tokens, None if open_ones else (task << 32) + count, offset, task)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += len(ids) // 4
                count += 1
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for part in sliced(batches):
            key_type = part.column("key").type
            for doc, ids in zip(part.column("key").to_pylist(), encode(part.column("text").to_pylist())):
                ids += end
                tokens = len(ids) // 4
                for start in range(0, tokens, size):
                    windows.place(doc, start, ids[4 * start : 4 * (start + size)], tokens)
            yield flush(False)
        if key_type is not None:
            out.extend(windows.left())
            yield flush(True)

    # What a window holds depends on the order of a task's rows, so it is written before anything is built on it.
    packed = materialize(source.mapInArrow(first, schema), "packed")
    done, left = packed.filter("sequence_id is not null"), packed.filter("sequence_id is null").withColumn("group", F.col("task"))
    groups, level = source.rdd.getNumPartitions(), 0
    while groups > 1 or level == 0:
        groups, level = -(-groups // MERGED_TASKS), level + 1
        last = groups == 1
        left = left.withColumn("group", F.floor(F.col("group") / MERGED_TASKS))
        merged = left.groupBy("group").applyInArrow(_merge(size, level, last), f"{schema}, group long")
        if not last:
            merged = materialize(merged, "merged")
            left = merged.filter("sequence_id is null")
            merged = merged.filter("sequence_id is not null")
        done = done.unionByName(merged.drop("group"))
    return done.drop("task").withColumnRenamed("key", key)


def _merge(size: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Fill windows with the pieces of a group's open windows, cutting where a window ends."""

    def merge(part: pa.Table) -> pa.Table:
        data = part.to_pydict()
        group = data["group"][0]
        order = sorted(range(part.num_rows), key=lambda i: (data["task"][i], str(data["key"][i]), data["start"][i]))
        columns: dict[str, list] = {name: [] for name in part.schema.names}
        total, room, sequence = sum(data["length"]), size, 0
        whole = total // size * size
        written = 0
        for i in order:
            at = 0
            while at < data["length"][i]:
                take = min(room, data["length"][i] - at)
                closed = last or written < whole
                row = {
                    "key": data["key"][i],
                    "start": data["start"][i] + at,
                    "length": take,
                    "ids": data["ids"][i][4 * at : 4 * (at + take)],
                    "doc_tokens": data["doc_tokens"][i],
                    "sequence_id": (level << 56) + (group << 28) + sequence if closed else None,
                    "offset": size - room,
                    "task": data["task"][i],
                    "group": group,
                }
                for name, value in row.items():
                    columns[name].append(value)
                at, room, written = at + take, room - take, written + take
                if not room:
                    room, sequence = size, sequence + 1
        return pa.table({name: pa.array(columns[name], part.schema.field(name).type) for name in part.schema.names})

    return merge

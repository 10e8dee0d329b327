"""Rows that go through a shuffle as compressed blocks of columns, so that it writes a fraction of what single rows take.

A task gathers some rows, orders them by the part that they go to, and sends each part one block; there the block becomes rows again.
Integers are stored in as few bytes as their range needs, equal strings in a row once, and a block is compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Bytes of rows that a task gathers before it sends blocks.
GATHERED = 64_000_000
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def arrow_schema(ddl: str) -> pa.Schema:
    """Of columns ``name type, name type`` of the types above."""
    return pa.schema([(name, TYPES[kind]) for name, kind in (column.split(" ") for column in ddl.split(", "))])


def _ints(values: np.ndarray) -> bytes:
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(i for i, w in enumerate(WIDTHS) if high - low <= np.iinfo(w).max)
    above = values.astype(np.int64).view(np.uint64) - np.array(low, dtype=np.int64).view(np.uint64)
    return struct.pack("<qBI", low, width, len(values)) + above.astype(WIDTHS[width]).tobytes()


def _encode(column: pa.Array) -> list[bytes]:
    held = [struct.pack("<?", column.null_count > 0)]
    if column.null_count:
        held.append(_ints(column.is_valid().to_numpy(zero_copy_only=False)))
    if pa.types.is_list(column.type):
        return [*held, _ints(pc.fill_null(pc.list_value_length(column), 0).to_numpy()), *_encode(column.flatten())]
    if not pa.types.is_string(column.type):
        return [*held, _ints(pc.fill_null(column, 0).to_numpy())]
    column = pc.fill_null(column, "")
    starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))) if len(column) else np.empty(0, np.int64)
    repeated = 2 * len(starts) < len(column)
    held.append(struct.pack("<?", repeated))
    if repeated:
        held.append(_ints(np.diff(starts, append=len(column))))
        column = column.take(pa.array(starts))
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset) if len(column) else np.zeros(1, np.int32)
    letters = column.buffers()[2]
    return [*held, _ints(np.diff(ends)), letters.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if letters is not None else b""]


class _Block:
    def __init__(self, held: bytes):
        self.held, self.at = held, 0

    def take(self, size: int) -> memoryview:
        self.at += size
        return memoryview(self.held)[self.at - size : self.at]

    def flag(self) -> bool:
        return struct.unpack("<?", self.take(1))[0]

    def ints(self) -> np.ndarray:
        low, width, size = struct.unpack("<qBI", self.take(13))
        above = np.frombuffer(self.take(size * np.dtype(WIDTHS[width]).itemsize), dtype=WIDTHS[width])
        return (above.astype(np.uint64) + np.array(low, dtype=np.int64).view(np.uint64)).view(np.int64)

    def column(self, kind: pa.DataType) -> pa.Array:
        valid = self.ints().astype(bool) if self.flag() else None
        empty = None if valid is None else pa.array(~valid)
        if pa.types.is_list(kind):
            ends = np.append(0, np.cumsum(self.ints())).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), self.column(kind.value_type), mask=empty)
        if not pa.types.is_string(kind):
            return pa.array(self.ints().astype(kind.to_pandas_dtype()), type=kind, mask=None if valid is None else ~valid)
        runs = self.ints() if self.flag() else None
        ends = np.append(0, np.cumsum(self.ints())).astype(np.int32)
        found = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(bytes(self.take(int(ends[-1])))))
        if runs is not None:
            found = found.take(pa.array(np.repeat(np.arange(len(runs)), runs)))
        return found if valid is None else pc.if_else(pa.array(valid), found, pa.scalar(None, kind))


def pack(rows: pa.RecordBatch) -> bytes:
    held = b"".join(piece for column in rows.columns for piece in _encode(column))
    return struct.pack("<q", len(held)) + pa.Codec("zstd", compression_level=3).compress(held, asbytes=True)


def unpack(block: bytes, schema: pa.Schema) -> pa.RecordBatch:
    (size,) = struct.unpack("<q", block[:8])
    held = _Block(pa.Codec("zstd").decompress(block[8:], size, asbytes=True))
    return pa.RecordBatch.from_arrays([held.column(f.type) for f in schema], schema=schema)


def _blocks(held: list[pa.RecordBatch], by: Sequence[str]) -> Batches:
    """A block for each part, its rows ordered by some columns, for what compresses well."""
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = [rows.column("part").to_numpy()]
    for name in by:
        values = rows.column(name).combine_chunks()
        if pa.types.is_string(values.type):
            words = values.dictionary_encode()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            place = np.empty(len(words.dictionary), dtype=np.int64)
            place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
            keys.append(place[words.indices.to_numpy()])
        else:
            keys.append(values.to_numpy())
    order = np.lexsort(keys[::-1])
    part = keys[0][order]
    starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1)) if len(part) else []
    ordered = rows.drop_columns(["part"]).take(pa.array(order)).combine_chunks()
    batch = ordered.to_batches()[0] if len(part) else None
    packed = [pack(batch.slice(start, end - start)) for start, end in zip(starts, [*starts[1:], len(part)])]
    yield pa.RecordBatch.from_arrays([pa.array(part[starts] if len(part) else [], pa.int32()), pa.array(packed, pa.binary())], names=["part", "block"])


def dealt(rows: DataFrame, place: Callable[[Batches], Batches], ddl: str, parts: int, by: Sequence[str] = ()) -> DataFrame:
    """What ``place`` makes of the rows, columns ``ddl`` and an int ``part`` that says in which partition of ``parts`` a row goes.

    Null parts are not allowed, nor are nulls in the columns ``by``, by which a block's rows are ordered.
    """
    schema = arrow_schema(ddl)

    def send(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in place(batches):
            held.append(batch.cast(schema.append(pa.field("part", pa.int32()))))
            size += batch.nbytes
            if size >= GATHERED:
                yield from _blocks(held, by)
                held, size = [], 0
        if held:
            yield from _blocks(held, by)

    def receive(batches: Batches) -> Batches:
        for batch in batches:
            for block in batch.column("block"):
                yield unpack(block.as_py(), schema)

    sent = rows.mapInArrow(send, "part int, block binary").repartitionById(parts, F.col("part"))
    return sent.select("block").mapInArrow(receive, ddl)


def spread(rows: DataFrame, parts: int) -> DataFrame:
    """The rows dealt out evenly to some partitions; in blocks where all columns are of the types above."""
    kinds = {name: kind.replace("bigint", "long") for name, kind in rows.dtypes}
    if not set(kinds.values()) <= set(TYPES):
        return rows.repartition(parts)

    def place(batches: Batches) -> Batches:
        at = TaskContext.get().partitionId()  # tasks of few rows do not all begin with the first part
        for batch in batches:
            part = np.arange(at, at + batch.num_rows) % parts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])
            at += batch.num_rows

    return dealt(rows, place, ", ".join(f"{name} {kind}" for name, kind in kinds.items()), parts)

"""What the operators share: bounded Arrow slices, word and shingle hashing, label folds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at a time inside a task, whatever the size of an Arrow batch.
SLICE_BYTES = 4_000_000

#: Maps every byte that is neither an ASCII letter or digit nor part of a non-ASCII character to a blank, and A-Z to a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_MASK = (1 << 64) - 1


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that a slice has one row or at most about ``limit`` text bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def map_slices(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text"
) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``make`` builds a task's tables once and returns what maps one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for part in sliced(batches, text):
            yield one(part)

    return df.mapInArrow(run, schema)


def fold(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts``; null keys give null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def fold_of(key: object, parts: int) -> int | None:
    """The same number outside Spark."""
    return None if key is None else zlib.crc32(str(key).encode()) % parts


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def rows(part: pa.RecordBatch, schema: str | None = None, **columns: object) -> pa.RecordBatch:
    """A batch of the named columns; values are arrays or lists."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def spread_read(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is dealt to all cores; a large one is read as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df

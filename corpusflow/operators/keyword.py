"""Keyword index: the indexed chunk texts are patterns, a query text is searched for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import grams
from corpusflow.operators.scale import best_of, small_enough, spread_join
from corpusflow.schema import require
from corpusflow.session import materialize

#: Window classes of the gram plan: patterns at least this long share a class (fixed values).
CLASSES = (1, 2, 4, 8, 16, 32, 64)
GRAM = 8
#: Patterns up to this number and total length are sent to the tasks.
PATTERN_ROWS, PATTERN_CHARS = 100_000, 8_000_000
#: Letters searched at a time inside a task; address bits of the filter for larger sets of patterns.
SLICE_LETTERS, FILTER_BITS = 200_000, 24
#: Hits that leave a task at a time.
HITS = 50_000


def build_index(chunks: DataFrame, seq: str | None = None) -> DataFrame:
    """Patterns (text, doc_id, offset, added): one row per distinct text.

    The same text added again takes over the key of its last addition (by ``seq``, else by key);
    empty texts are not patterns.  ``added`` counts the additions.
    """
    require(chunks, doc_id="bigint", offset="int", text="string")
    order = F.struct(*([seq] if seq else []), "doc_id", "offset")
    index = chunks.filter("text <> ''").groupBy("text").agg(
        F.max_by(F.struct("doc_id", "offset"), order).alias("k"), F.count(F.lit(1)).alias("added")
    )
    return index.select("text", "k.doc_id", "k.offset", "added")


def index_stats(index: DataFrame) -> DataFrame:
    """One row: number of patterns and of additions."""
    return index.agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("added"), F.lit(0)).alias("size"))


def _gram_hashes(letters: np.ndarray, width: int) -> np.ndarray:
    """One polynomial hash per position of the ``width``-letter grams."""
    hashes = np.zeros(len(letters) - width + 1, dtype=np.uint64)
    for i in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + letters[i : i + len(hashes)]
    return hashes ^ (hashes >> np.uint64(29))


def _anchors(text: str, cls: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams chosen in the windows of ``cls`` letters of the text.

    From each window the smallest hash (leftmost on ties) is chosen, so equal windows choose equal
    grams wherever they stand, and neighbouring windows mostly share their choice.
    """
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(letters) < cls:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    width = min(GRAM, cls)
    hashes = _gram_hashes(letters, width)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, cls - width + 1)
    chosen = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
    return chosen, hashes[chosen].view(np.int64)


def _anchor_frames(
    frame: pd.DataFrame, text: str, classes: Callable[[str], list[int]], keep: list[str]
) -> Iterator[pd.DataFrame]:
    """(cls, gram, pos, *keep) of the anchors of all texts in a batch, in frames of bounded size."""
    found: list[tuple] = []
    held = 0

    def merged() -> pd.DataFrame:
        rows, cls, gram, pos = (np.concatenate(column) for column in zip(*found))
        kept = frame[keep].iloc[rows].reset_index(drop=True)
        return kept.assign(cls=cls, gram=gram, pos=pos)

    for row, value in enumerate(frame[text]):
        for cls in classes(value):
            pos, gram = _anchors(value, cls)
            found.append((np.full(len(pos), row), np.full(len(pos), cls), gram, pos))
            held += len(pos)
        if held > 200_000:
            yield merged()
            found, held = [], 0
    if found:
        yield merged()


def _bitmap(keyed: DataFrame) -> np.ndarray:
    """Which addresses (the lowest bits of a hash) the patterns' anchors have: ``2 ** FILTER_BITS`` bits, whatever their number."""
    address = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    page = 1 << 15  # bits that one aggregate holds
    parts = keyed.groupBy(F.shiftright(address, 15).alias("page")).agg(F.bitmap_construct_agg(address % page).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // page * (page >> 3), dtype=np.uint8)
    for row in parts.collect():  # one row per page at most
        out[row["page"] * (page >> 3) : (row["page"] + 1) * (page >> 3)] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _occurrences(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Counts per query row and pattern by an equi-join on anchor grams: (row, doc_id, offset, n, first_end, pattern_length).

    A pattern is keyed by one anchor of its windows; a query text emits (class, hash, position) of those of its anchors
    that a bitmap of the patterns' anchors lets pass.  Equal windows have equal
    anchors, so every occurrence is a candidate exactly once; each is then compared with the text.  The texts do not
    travel: candidates, few against all positions, are stored and brought to them.
    """

    def pattern_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(text: str) -> list[int]:
            return [max(c for c in CLASSES if c <= len(text))]

        for frame in frames:
            for found in _anchor_frames(frame, "pattern", of, ["number"]):
                yield found.rename(columns={"cls": "p_cls", "pos": "at"})

    lengths = F.greatest(*[F.when(F.length("pattern") >= c, c) for c in CLASSES], F.lit(0))
    classes = [r[0] for r in patterns.select(lengths.alias("c")).distinct().collect()]  # at most one per class

    def text_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for found in _anchor_frames(frame, "text", lambda _: classes, ["row"]):
                address = found["gram"].to_numpy() & ((1 << FILTER_BITS) - 1)
                held = np.unpackbits(sent.value[address >> 3][:, None], axis=1, bitorder="little")
                yield found[held[np.arange(len(found)), address & 7] > 0]

    numbered = materialize(patterns.withColumn("number", F.monotonically_increasing_id()), "numbered")
    anchors = numbered.select("number", "pattern").mapInPandas(
        pattern_anchors, "number long, p_cls int, gram long, at long"
    )
    # Of a pattern's anchors the one fewest patterns share, so near copies do not share a key.
    shared = anchors.groupBy("p_cls", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = anchors.join(shared, ["p_cls", "gram"]).groupBy("number", "p_cls").agg(
        F.min(F.struct("n", "at", "gram")).alias("a")
    )
    keyed = materialize(rarest.select("number", F.col("p_cls").alias("cls"), "a.at", "a.gram"), "anchors")
    sent = queries.sparkSession.sparkContext.broadcast(_bitmap(keyed))
    anchored = queries.mapInPandas(text_anchors, "cls int, gram long, pos long, row long")
    spread = spread_join(anchored, keyed.withColumnRenamed("cls", "p_cls"), "gram").filter("cls = p_cls")
    candidates = materialize(spread.select("row", "number", (F.col("pos") - F.col("at")).alias("start")).filter("start >= 0"), "candidates")
    patterns = candidates.join(numbered, "number").select("row", "doc_id", "offset", "pattern", "start")
    length = F.length("pattern")
    same = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), length) == F.col("pattern")
    verified = patterns.join(queries.select("row", "text"), "row").filter(same)
    counts = verified.groupBy("row", "doc_id", "offset").agg(F.count(F.lit(1)).alias("n"), _first(F.col("start") + length, length).alias("e"))
    return counts.select("row", "doc_id", "offset", "n", _end("e").alias("first_end"), _length("e").alias("pattern_length"))


#: Letters of a text are numbered below this.
LETTERS = 1 << 31


def _first(end: Column, length: Column) -> Column:
    """The earliest end, of equal ones that of the longest pattern, as one number: it is aggregated by hash, without sorting the hits."""
    return F.min(end.cast("long") * LETTERS + (LETTERS - 1 - length.cast("long")))


def _end(first: str) -> Column:
    return F.shiftright(first, 31)


def _length(first: str) -> Column:
    return LETTERS - 1 - F.col(first).bitwiseAND(F.lit(LETTERS - 1))


def _shipped(queries: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences per query row and pattern, found inside the tasks, to which all patterns are sent (they are proven few).

    Only hits leave a task: (*key, doc_id, offset, n, first_end, pattern_length).
    """
    rows = patterns.collect()
    table = grams.GramTable([r["pattern"] for r in rows])
    # Plain arrays are sent; the class itself travels with the function, so executors need no copy of the package.
    keys = pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["offset"] for r in rows], pa.int32())
    sent = queries.sparkSession.sparkContext.broadcast((vars(table), *keys))
    names = [f"key_{i}" for i in range(len(key))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, docs, offsets = sent.value
        table = grams.GramTable.of(arrays)
        for batch in batches:
            letters = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            part = letters // SLICE_LETTERS
            starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                some = batch.slice(start, end - start)
                text, pattern, n, first = table.counts([t or "" for t in some.column("text").to_pylist()])
                # Texts of one key are added up here, so that a pattern has one row per key and slice.
                found = pa.Table.from_arrays([*(some.column(c).take(pa.array(text)) for c in key), pa.array(pattern), pa.array(n), pa.array(first)], names=[*names, "which", "n", "first"])
                found = found.group_by([*names, "which"]).aggregate([("n", "sum"), ("first", "min")])
                for begin in range(0, found.num_rows, HITS):
                    piece = found.slice(begin, HITS).combine_chunks()
                    which, first = piece.column("which").combine_chunks(), piece.column("first_min").to_numpy()
                    length = table.lengths[which.to_numpy()]
                    columns = [piece.column(c).combine_chunks() for c in names] + [docs.take(which), offsets.take(which)]
                    columns += [piece.column("n_sum").combine_chunks(), pa.array(first + length), pa.array(length, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*key, "doc_id", "offset", "n", "first_end", "pattern_length"])

    kinds = dict(queries.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", doc_id long, offset int, n long, first_end long, pattern_length int"
    return queries.mapInArrow(search, schema)


def match(queries: DataFrame, index: DataFrame, key: Sequence[str] = ("request_id",)) -> DataFrame:
    """All occurrences, overlapping ones included, of every pattern in every query text.

    ``queries`` holds a text and key columns, by default (request_id, text); rows of one key are searched one by one
    and their occurrences added.  Result: (*key, doc_id, offset, weight 1.0, relevance = occurrences,
    first_end = the earliest end in any of them, pattern_length); queries without a match have no row.

    Patterns up to ``PATTERN_ROWS`` and ``PATTERN_CHARS`` are sent to the tasks, where a gram table finds them; more of them
    meet the texts in a join on gram hashes.
    """
    require(queries, text="string")
    require(index, doc_id="bigint", offset="int", text="string")
    key = list(key)
    texts = queries.select(*key, "text").filter("text is not null")
    patterns = materialize(index.select("doc_id", "offset", F.col("text").alias("pattern")).filter("pattern <> ''"), "patterns")
    if small_enough(patterns, "pattern", PATTERN_ROWS, PATTERN_CHARS):
        counts = _shipped(texts, patterns, key)
    else:
        # Rows get numbers of their own, so texts that share a key are never checked against each other's positions.
        texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        found = _occurrences(texts.select("row", "text"), patterns)
        counts = materialize(found, "occurrences").join(texts.select("row", *key), "row")
    summed = counts.groupBy(*key, "doc_id", "offset").agg(F.sum("n").alias("n"), _first(F.col("first_end"), F.col("pattern_length")).alias("e"))
    return summed.select(
        *key,
        "doc_id",
        "offset",
        F.lit(1.0).alias("weight"),
        F.col("n").cast("double").alias("relevance"),
        _end("e").alias("first_end"),
        _length("e").cast("int").alias("pattern_length"),
    )


#: Order of hits: most occurrences, then earliest end, then longest pattern, then key.
HIT_ORDER = ("relevance DESC", "first_end", "pattern_length DESC", "doc_id", "offset")


def search(queries: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """Top k patterns per query: (request_id, rank, doc_id, offset, weight, relevance).

    Without ``k`` each request's own ``top_k`` column counts; requests of one id must agree on it.
    """
    order = [F.desc(c.split()[0]) if c.endswith("DESC") else F.asc(c) for c in HIT_ORDER]
    best = best_of(match(queries, index), queries, order, k)
    return best.select("request_id", "rank", "doc_id", "offset", "weight", "relevance")

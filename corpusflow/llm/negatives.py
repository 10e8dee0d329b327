"""Hard-negative mining by threshold joins over inverted lists with suffix-norm bounds.

A window asks for the best rows between two scores.  The join starts every window at a high threshold and answers it if enough rows
reach that; the windows left unfilled go again with a lower one, at last with the lowest score they admit, so answers are exact.

Rows are dealt to blocks.  A task turns its block into inverted lists, strip after strip of dimensions in the order of their energy; a
row is not indexed from the dimension on where the norm of its rest, times the largest rest of the anchors relative to their
thresholds, stays below one: its rest alone cannot reach any threshold.  Partial scores are accumulated along the lists; a pair whose
partial score and norms of the rests cannot reach its threshold is dropped, and what is left is completed exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import top_k
from corpusflow.session import materialize

#: Rows of a block and anchors of a crowd that are multiplied at a time.
BLOCK, CROWD = 4096, 512
#: Blocks, and crowds, that one task holds.
HELD = 16
#: Rows that thresholds are first estimated on at most.
MOST_SAMPLED = 4096
#: Dimensions accumulated between two prunings; share of live pairs below which they are completed one by one.
STRIP, FEW = 8, 0.1
#: Where windows start: thresholds that let expect so many times the rows needed.  The last round asks for all in the window.
TIMES = (2, 16)


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of all components, as doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable_rows(rows: DataFrame, label: Column, key: str, vector: str, scale: int) -> DataFrame:
    """``row, id, label, vector``: rows that take part, with numbers of their own, their vectors quantised."""
    parts = F.col(vector)
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(key).alias("id"), label.alias("label"), parts.alias(vector))
    kept = kept.filter("id is not null and label is not null").filter(parts.isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", quantised(parts, scale).alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values):
        out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def rest_norms(matrix: np.ndarray) -> np.ndarray:
    """Norm of each row's components from every strip's start on; the last column is zero."""
    width = matrix.shape[1]
    starts = list(range(0, width, STRIP))
    squares = np.array([(matrix[:, s:] ** 2).sum(axis=1) for s in starts] + [np.zeros(len(matrix))])
    return np.sqrt(squares.T)


def pairs_above(anchors: np.ndarray, rows: np.ndarray, thresholds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all ``wanted`` pairs whose inner product reaches the anchor's threshold.

    Vectors hold integers, so scores are exact up to 2^53; bounds are rounded upwards.
    """
    width = anchors.shape[1]
    a_rest, r_rest = rest_norms(anchors), rest_norms(rows)
    # How much of its threshold an anchor can still get from each strip on, for rows of norm one; a threshold of zero or less needs all.
    with np.errstate(divide="ignore", invalid="ignore"):
        relative = np.where(thresholds[:, None] > 0, a_rest / thresholds[:, None], np.inf).max(axis=0, initial=0.0)
        indexed = (r_rest * relative[None, :])[:, :-1] * (1 + 1e-9) >= 1 - 1e-9
    indexed |= np.isinf(relative)[None, :-1]
    strips = indexed.shape[1]
    scores = np.zeros((len(anchors), len(rows)))
    listed = indexed.any(axis=1)  # the others reach no threshold
    live = wanted & listed[None, :]
    reached = 0
    for strip in range(strips):
        on = np.flatnonzero(indexed[:, strip])
        if not len(on):
            break
        part = slice(strip * STRIP, (strip + 1) * STRIP)
        scores[:, on] += anchors[:, part] @ rows[on, part].T
        reached = strip + 1
        # A row not listed here has all its rest from here on to come, one listed what follows the strip.
        following = np.where(indexed[:, strip], r_rest[:, strip + 1], r_rest[:, strip])
        rest = np.where(indexed[None, :, strip], a_rest[:, strip + 1, None], a_rest[:, strip, None]) * following[None, :]
        live &= scores + rest * (1 + 1e-9) + 1e-6 >= thresholds[:, None]
        if live.mean() < FEW:
            break
    a, r = np.nonzero(live)
    found = scores[a, r]
    # A row's lists end with its own index, or with the strip where accumulation stopped.
    ends = np.minimum(indexed.sum(axis=1), reached)[r]
    for strip in range(strips):
        late = ends <= strip
        part = slice(strip * STRIP, (strip + 1) * STRIP)
        if late.any() and strip * STRIP < width:
            found[late] += (anchors[a[late], part] * rows[r[late], part]).sum(axis=1)
    kept = found >= thresholds[a]
    return a[kept], r[kept], found[kept]


def _first(group: np.ndarray, fits: np.ndarray, need: int) -> np.ndarray:
    """Places of the first ``need`` fitting entries of every group; entries of a group stand together."""
    at = np.flatnonzero(fits)
    own = group[at]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[place < need]


def _join_cell(width: int, need: int, alike: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first ``need`` rows of a cell's blocks for every window of its anchors."""

    def join(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[pa.Table] = [_found([], [], [], [], [])]
        if not asks.num_rows or not rows.num_rows:
            return out[0]
        codes = {value: i for i, value in enumerate({*asks.column("label").to_pylist(), *rows.column("label").to_pylist()})}
        row_code = np.array([codes[v] for v in rows.column("label").to_pylist()])
        row_number, row_id = rows.column("row").to_numpy(), rows.column("id").to_numpy()
        for begin in range(0, asks.num_rows, CROWD):
            crowd = asks.slice(begin, CROWD)
            names, code = crowd.column("anchor").to_numpy(), np.array([codes[v] for v in crowd.column("label").to_pylist()])
            anchors, windows = _matrix(crowd.column("vector"), width), crowd.column("windows").to_pylist()
            most = max(map(len, windows))
            low, high = np.full((len(names), most), np.inf), np.full((len(names), most), -np.inf)
            number = np.zeros((len(names), most), dtype=np.int64)
            for i, own in enumerate(windows):
                for j, w in enumerate(own):
                    low[i, j], high[i, j], number[i, j] = w["low"], w["high"], w["window"]
            for start in range(0, rows.num_rows, BLOCK):
                block = slice(start, start + BLOCK)
                wanted = (code[:, None] == row_code[None, block]) == alike
                a, r, score = pairs_above(anchors, _matrix(rows.column("vector").slice(start, BLOCK), width), low.min(axis=1), wanted)
                r += start
                other = row_number[r] != names[a]
                a, r, score = a[other], r[other], score[other]
                order = np.lexsort((row_number[r], row_id[r], -score, a))
                a, r, score = a[order], r[order], score[order]
                for j in range(most):
                    at = _first(a, (score >= low[a, j]) & (score <= high[a, j]), need)
                    if len(at):
                        out.append(_found(names[a[at]], number[a[at], j], row_number[r[at]], row_id[r[at]], score[at]))
        return pa.concat_tables(out)

    return join


def _found(anchor, window, row, near, score) -> pa.Table:
    arrays = [pa.array(anchor, pa.int64()), pa.array(window, pa.int32()), pa.array(row, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64())]
    return pa.Table.from_arrays(arrays, names=["anchor", "window", "row", "id", "score"])


class Base:
    """The rows in blocks, stored once, with their dimensions in the order of energy, and a bounded sample of them."""

    def __init__(self, rows: DataFrame):
        stored = materialize(rows, "rows")
        sums = stored.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
        order = [at for _, at in sorted((-r["e"], r["at"]) for r in sums.collect())]  # one row per dimension
        self.width, self.count = len(order), stored.count()
        padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("vector")))
        picked = F.transform(F.array(*[F.lit(at) for at in order]), lambda at: F.element_at(padded, at + 1))
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.groups = max(1, -(-self.count // (BLOCK * HELD)), min(cores, -(-self.count // BLOCK)))
        part = F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int").alias("part")
        self.rows = materialize(stored.select("row", "id", "label", picked.alias("vector") if order else "vector", part), "blocks")
        self.sample = self.rows.orderBy(F.xxhash64("row", F.lit(5)), "row").limit(MOST_SAMPLED).drop("part")


def threshold_join(base: Base, anchors: DataFrame, windows: DataFrame, need: int, alike: bool) -> DataFrame:
    """``anchor, window, row, id, score, rank``: each window's first ``need`` rows with ``floor <= score <= high``.

    ``anchors`` holds ``anchor`` (a row number of the base), ``label, vector``; ``windows`` holds ``anchor, window, floor, high``.
    ``alike`` asks for rows of the anchor's label, else for those of other labels.  Order: higher scores, then smaller ids.
    """
    open_, answers = materialize(_expected(base, anchors, windows, need, alike), "windows"), None
    for step in range(len(TIMES) + 1):
        last = step == len(TIMES)
        asked = open_.withColumn("low", F.col("floor") if last else F.greatest("floor", F.col("steps")[step]))
        found = materialize(_join(base, anchors, asked, need, alike), "found")
        filled = asked.join(found.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")), ["anchor", "window"], "left")
        settled = (F.coalesce("n", F.lit(0)) >= need) | (F.col("low") <= F.col("floor"))
        done = found.join(filled.filter(settled).select("anchor", "window"), ["anchor", "window"], "left_semi")
        answers = done if answers is None else answers.unionByName(done)
        if last:
            break
        open_ = materialize(filled.filter(~settled).drop("n", "low"), "windows")
        if open_.isEmpty():
            break
    return answers


def _with_windows(anchors: DataFrame, windows: DataFrame, *columns: str) -> DataFrame:
    """One row per anchor with the list of its windows."""
    return anchors.join(windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", *columns))).alias("windows")), "anchor")


def _expected(base: Base, anchors: DataFrame, windows: DataFrame, need: int, alike: bool) -> DataFrame:
    """The windows with ``steps``: thresholds at which the sample lets expect ``TIMES`` the rows needed.

    They only say where a window starts.
    """
    width, count = base.width, base.count
    sample = base.sample.toArrow()  # at most MOST_SAMPLED rows
    matrix, labels = _matrix(sample.column("vector"), width), sample.column("label").to_pylist()
    codes = {value: i for i, value in enumerate(set(labels))}
    own = np.array([codes[v] for v in labels], dtype=np.int64)
    places = [int(np.ceil(times * need * len(matrix) / max(count, 1))) for times in TIMES]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns: list[list] = [[] for _ in range(5)]
            for start in range(0, part.num_rows, CROWD):
                some = part.slice(start, CROWD)
                scores = _matrix(some.column("vector"), width) @ matrix.T
                for line, anchor, label, asked in zip(scores, *(some.column(c).to_pylist() for c in ("anchor", "label", "windows"))):
                    line = np.sort(line[(own == codes.get(label, -1)) == alike])
                    for w in asked:
                        end = int(np.searchsorted(line, w["high"], "right"))
                        row = anchor, w["window"], w["floor"], w["high"], [float(line[end - 1 - at]) if at < end else -np.inf for at in places]
                        for column, value in zip(columns, row):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "window", "floor", "high", "steps"])

    return _with_windows(anchors, windows, "floor", "high").mapInArrow(steps, "anchor long, window int, floor double, high double, steps array<double>")


def _join(base: Base, anchors: DataFrame, windows: DataFrame, need: int, alike: bool) -> DataFrame:
    """One pass of all rows against the windows from ``low`` on, ranked.

    A set of crowds and a group of blocks are one task's work; neither side is held whole, and rows are copied once for every
    ``CROWD * HELD`` anchors.
    """
    asks = materialize(_with_windows(anchors, windows, "low", "high"), "asks")
    crowds = max(1, -(-asks.count() // (CROWD * HELD)))
    dealt = asks.withColumn("crowd", F.pmod(F.xxhash64("anchor"), F.lit(crowds)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(base.groups - 1))))
    rows = base.rows.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    joined = dealt.groupBy("part", "crowd").cogroup(rows.groupBy("part", "crowd"))
    found = joined.applyInArrow(_join_cell(base.width, need, alike), "anchor long, window int, row long, id long, score double")
    return top_k(found, ["anchor", "window"], [F.desc("score"), F.asc("id"), F.asc("row")], need)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are integer inner products of components ``floor(scale * x)``.  ``anchors`` is a condition on ``id``.  An anchor's
    positives are its first ``positives`` other rows of the same ``label``; for each of them the first ``negatives`` rows of
    other labels come back whose score is between ``least`` and ``most`` percent of the positive's (none if that is negative).
    Higher scores come first, ties by smaller id.

    Rows with a null key, label or vector, or with null or non-finite components, take no part.  An empty vector scores zero with
    all; of vectors of different lengths the shorter counts as filled up with zeros.  Every row is a row of its own, so a repeated
    one is found as often as it is there, and a repeated anchor answers for each of its rows.  Scores beyond 2^53 are rounded to
    doubles, those beyond a long are null.  Other columns are ignored; no rows give no rows.
    """
    base = Base(usable_rows(rows, label, key, vector, scale))
    chosen = materialize(base.rows.filter(anchors).select(F.col("row").alias("anchor"), "id", "label", "vector"), "anchors")
    everything = chosen.select("anchor", F.lit(0).alias("window"), F.lit(float("-inf")).alias("floor"), F.lit(float("inf")).alias("high"))
    found = threshold_join(base, chosen, everything, positives, alike=True)
    found = materialize(found.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.expr("try_cast(positive_score as bigint)")
    reach = found.filter("positive_score >= 0").select("anchor", "window", score.alias("score"))
    windows = reach.selectExpr("anchor", "window", f"double(({least} * score + 99) div 100) as floor", f"double({most} * score div 100) as high")
    near = threshold_join(base, chosen, windows.filter("floor <= high"), negatives, alike=False)
    named = near.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = named.join(found, ["anchor", "window"]).join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        score.alias("positive_score"),
        F.expr("try_cast(negative_score as bigint)").alias("negative_score"),
    )


#: The same rows as the registered query's in DuckDB.
SQL = """
WITH base AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.row AS anchor, a.id AS anchor_id, b.row, b.id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM base a JOIN base b ON a.id % 100 = 0 AND a.row <> b.row
), positives AS (
    SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.id)::INTEGER AS rank
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike
WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

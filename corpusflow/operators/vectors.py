"""Vector index: exact and approximate nearest neighbours of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import best_of, top_k, wanted_hits
from corpusflow.session import materialize

METRICS = ("l2", "cosine")
#: Query vectors are shipped to all tasks up to this many cells, and compared in blocks of this many rows.
QUERY_CELLS = 4_000_000
BLOCK = 2048
#: A tile: queries and vectors multiplied at a time, whatever a block holds; and pairs scored exactly at a time.
TILE_QUERIES, TILE_VECTORS, SCORED = 1024, 2048, 20_000
CANDIDATES = "request_id long, vec_id long, distance double"
#: Norms between which products in single precision propose pairs; of a tile, the share of pairs beyond which double precision does.
SINGLE, CROWDED = (1e-15, 1e15), 1 / 8


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean distance, or 1 - cosine similarity (1 if a vector is zero), summed in doubles."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    if metric == "l2":
        parts = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda s, d: s + d * d)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ v.T
    if metric == "l2":
        dots *= -2
        dots += (q * q).sum(1)[:, None]
        dots += (v * v).sum(1)[None, :]
        return np.maximum(dots, 0.0, out=dots)
    norms = np.sqrt((q * q).sum(1)[:, None] * (v * v).sum(1)[None, :])
    return np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), 1.0)


def _error_bound(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """How far ``_distances`` may be off, per query: rounding of sums of products of these lengths, with room to spare."""
    size, tiny = q.shape[1], np.finfo(np.float64).eps
    if metric == "cosine":
        return np.full((len(q), 1), 16 * (size + 4) * tiny)
    largest = np.sqrt((v * v).sum(1)).max(initial=0.0)
    return 8 * (size + 4) * tiny * (np.sqrt((q * q).sum(1))[:, None] + largest) ** 2


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs (row by row): sums of squared differences, not differences of large squares."""
    if metric == "l2":
        return ((q - v) ** 2).sum(1)
    norms = np.sqrt((q * q).sum(1) * (v * v).sum(1))
    return np.where(norms > 0, 1 - (q * v).sum(1) / np.where(norms > 0, norms, 1), 1.0)


def _nearest(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, metric: str) -> tuple:
    """Pairs (request ids, vector ids, rounded distances) of one block: the k nearest per query row, ties by id.

    The matrix product proposes all pairs that can be among these within its error; they are scored again exactly.  Both sides
    are cut into tiles: the k-th distance of the tiles before is the bound for the next one, so memory does not grow with the block.
    """
    if k < 1 or not len(q):
        return qid[:0], vid[:0], np.empty(0)
    right = _right(v, metric)
    done = [_nearest_of_tiles(q[i : i + TILE_QUERIES], vid, v, k, metric, right) for i in range(0, len(q), TILE_QUERIES)]
    rows = [row + i for (row, _, _), i in zip(done, range(0, len(q), TILE_QUERIES))]
    return qid[np.concatenate(rows)], np.concatenate([ids for _, ids, _ in done]), np.concatenate([dist for _, _, dist in done])


def _safe(norms: np.ndarray) -> bool:
    """Whether squares of these lengths, and products in single precision, neither overflow nor vanish."""
    return bool(np.isfinite(norms).all() and not ((norms < SINGLE[0]) & (norms > 0)).any() and not (norms > SINGLE[1]).any())


def _right(v: np.ndarray, metric: str) -> tuple[np.ndarray, float] | None:
    """The vectors as ``_left`` multiplies them, in single precision, and their largest length; nothing where that is not safe."""
    squares = (v * v).sum(1)
    norms = np.sqrt(squares)
    if not _safe(norms):
        return None
    scaled = np.hstack([v, squares[:, None]]) if metric == "l2" else v / np.where(norms > 0, norms, 1)[:, None]
    return scaled.astype(np.float32), norms.max(initial=0.0)


def _left(q: np.ndarray, largest: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(left, base, error) such that ``left @ right.T + base`` is the distances within the error; nothing where that is not safe."""
    squares = (q * q).sum(1)[:, None]
    norms, size, tiny = np.sqrt(squares), q.shape[1], np.finfo(np.float32).eps
    if not _safe(norms):
        return None
    if metric == "l2":
        left, base, error = np.hstack([-2 * q, np.ones_like(squares)]), squares, 2 * (size + 4) * tiny * (norms + largest) ** 2
    else:
        left, base, error = -q / np.where(norms > 0, norms, 1), np.ones_like(squares), np.full_like(squares, 4 * (size + 4) * tiny)
    return left.astype(np.float32), base, error


def _proposed(rough: np.ndarray, bound: np.ndarray | None, k: int, room: np.ndarray) -> np.ndarray:
    """Places of the pairs (row by row) that may be within each row's bound, by default the k-th smallest of the row."""
    if bound is None:
        last = min(k, rough.shape[1]) - 1
        bound = np.partition(rough, last, axis=1)[:, last : last + 1]
    return np.flatnonzero(rough <= (bound + room).astype(rough.dtype))


def _nearest_of_tiles(q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, metric: str, right: tuple[np.ndarray, float] | None) -> tuple:
    """(query rows, vector ids, rounded distances) of the k nearest distinct pairs per query, among its k smallest distances and their ties.

    Products in single precision propose pairs; those in double precision where too many pairs lie within the error of the former.
    """
    slack = 2e-6  # keeps pairs that are equal after rounding
    single = None if right is None else _left(q, right[1], metric)
    row, ids, dist = np.empty(0, dtype=np.int64), vid[:0], np.empty(0)
    smallest = np.full((len(q), k), np.inf)  # of each query the k smallest distances so far, repeated ones too
    for at in range(0, len(vid), TILE_VECTORS):
        tile, names = v[at : at + TILE_VECTORS], vid[at : at + TILE_VECTORS]
        bound, places = None if at == 0 else smallest[:, -1:], None
        if single is not None:
            left, base, error = single
            places = _proposed(left @ right[0][at : at + TILE_VECTORS].T, None if bound is None else bound - base, k, 2 * error + slack)
        if places is None or len(places) > CROWDED * len(q) * len(names):
            places = _proposed(_distances(q, tile, metric), bound, k, 2 * _error_bound(q, v, metric) + slack)
        new, col = np.divmod(places, len(names))
        if not len(new):
            continue
        rounded = np.empty(len(new))
        for i in range(0, len(new), SCORED):
            some = slice(i, i + SCORED)
            rounded[some] = np.round(_exact(q[new[some]], tile[col[some]], metric), 6) + 0.0
        _lower(smallest, new, rounded)
        row, ids, dist = np.concatenate([row, new]), np.concatenate([ids, names[col]]), np.concatenate([dist, rounded])
        row, ids, dist = _first_distinct(row, ids, dist, smallest[:, -1], k)
    return row, ids, dist


def _lower(smallest: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """Bring more values into the sorted ``smallest`` of their rows."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    few = place < smallest.shape[1]
    touched, where = np.unique(row[few], return_inverse=True)
    more = np.full((len(touched), smallest.shape[1]), np.inf)
    more[where, place[few]] = values[few]
    smallest[touched] = np.sort(np.concatenate([smallest[touched], more], axis=1), axis=1)[:, : smallest.shape[1]]


def _first_distinct(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, bound: np.ndarray, k: int) -> tuple:
    """Of each row the first k distinct (distance, id) up to the row's bound."""
    order = np.lexsort((ids, dist, row))
    order = order[dist[order] <= bound[row[order]]]
    row, ids, dist = row[order], ids[order], dist[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (dist[1:] != dist[:-1]) | (ids[1:] != ids[:-1])
    row, ids, dist = row[fresh], ids[fresh], dist[fresh]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[first], dist[first]


def _best(pairs: list[tuple], k: int) -> pd.DataFrame:
    """The k best distinct vectors per query of several partial results, ties by id."""
    if not pairs:
        return pd.DataFrame({"request_id": [], "vec_id": [], "distance": []})
    request, vec, dist = (np.concatenate(column) for column in zip(*pairs))
    rows = pd.DataFrame({"request_id": request, "vec_id": vec, "distance": dist}).drop_duplicates()
    return rows.sort_values(["request_id", "distance", "vec_id"]).groupby("request_id", sort=False).head(k)


def _with_shipped_queries(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """Each task compares its vectors to all queries and keeps k per query; no vector is shuffled."""
    rows = queries.select("request_id", "vector").toPandas()
    if rows.empty:
        return queries.sparkSession.createDataFrame([], CANDIDATES)
    shipped = queries.sparkSession.sparkContext.broadcast((rows["request_id"].to_numpy(), _matrix(rows["vector"])))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shipped.value
        held: list[tuple] = []
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                block = frame.iloc[at : at + BLOCK]
                vid, v = block["vec_id"].to_numpy(), _matrix(block["vector"])
                held += [
                    _nearest(qid[i : i + BLOCK], q[i : i + BLOCK], vid, v, k, metric) for i in range(0, len(qid), BLOCK)
                ]
                best = _best(held, k)
                held = [tuple(best[c].to_numpy() for c in best.columns)]
        if held:
            yield _best(held, k)

    return vectors.select("vec_id", "vector").mapInPandas(scan, CANDIDATES)


def _compare_groups(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """Compare the queries and vectors that share (part, qb, vb, bucket), keeping k per query and group.

    A (part, qb, vb) is one task's group and may hold several small buckets.
    """

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        inside = right.groupby("bucket").indices
        pairs = []
        for bucket, at in left.groupby("bucket").indices.items():
            if bucket not in inside:
                continue
            some = right.iloc[inside[bucket]]
            vid, vec = some["vec_id"].to_numpy(), _matrix(some["vector"])
            asking = left.iloc[at]
            pairs.append(_nearest(asking["request_id"].to_numpy(), _matrix(asking["vector"]), vid, vec, k, metric))
        return _best(pairs, k)

    key = ["part", "qb", "vb"]
    vectors = vectors.withColumnsRenamed({c: f"v_{c}" for c in key})
    return queries.groupBy(*key).cogroup(vectors.groupBy(*[f"v_{c}" for c in key])).applyInPandas(compare, CANDIDATES)


def _copies(df: DataFrame, key: str, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Put each row in one of its side's blocks and repeat it for every block of the other side."""
    placed = df.withColumn(own, F.pmod(F.xxhash64(key), own_blocks).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1))).select(
        "part", "qb", "vb", "bucket", key, "vector"
    )


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """All queries against all vectors: both sides cut into blocks, every pair of blocks one group."""

    def blocks(df: DataFrame) -> Column:
        return F.lit(df.count() // block_rows + 1).cast("int")

    one = {"part": F.lit(0), "bucket": F.lit(0)}
    nq, nv = blocks(queries), blocks(vectors)
    q = _copies(queries.withColumns(one), "request_id", "qb", nq, "vb", nv)
    v = _copies(vectors.withColumns(one), "vec_id", "vb", nv, "qb", nq)
    return _compare_groups(q, v, k, metric)


def _by_buckets(queries: DataFrame, vectors: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """Queries against the vectors of the same ``bucket``.

    A bucket of more than ``block_rows`` rows is cut into blocks on both sides; small buckets share
    groups of about that size.  So groups are bounded whatever the buckets hold.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    sizes = counted(queries, "q").join(counted(vectors, "v"), "bucket")
    shared = int(sizes.agg(F.coalesce(F.sum(F.col("q") + F.col("v")), F.lit(0))).first()[0] // block_rows + 1)
    shared = max(shared, queries.sparkSession.sparkContext.defaultParallelism)
    large = (F.col("q") > block_rows) | (F.col("v") > block_rows)
    part = F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(shared)))
    cut = [F.ceil(F.col(c) / block_rows).cast("int").alias(f"{c}_blocks") for c in ("q", "v")]
    sizes = sizes.select("bucket", part.cast("long").alias("part"), *cut)
    nq, nv = F.col("q_blocks"), F.col("v_blocks")
    q = _copies(queries.join(sizes, "bucket"), "request_id", "qb", nq, "vb", nv)
    v = _copies(vectors.join(sizes, "bucket"), "vec_id", "vb", nv, "qb", nq)
    return _compare_groups(q, v, k, metric)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int | None, metric: str = "l2", plan: str | None = None, block_rows: int = 20_000
) -> DataFrame:
    """Exact k nearest vectors per query: (request_id, rank, vec_id, distance), ties by id.

    ``queries`` is (request_id, vector[, top_k]), ``vectors`` is (vec_id, vector); without ``k`` each request's own ``top_k``
    counts.  Distances are rounded to six places.  ``plan`` is ``ship`` (queries go to every task) or ``blocks``; by default the size of the
    queries decides.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if plan is None:
        cells = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
        plan = "ship" if cells <= QUERY_CELLS else "blocks"
    most = k if k is not None else wanted_hits(queries, None)[1]
    asked = queries.select("request_id", "vector")
    if plan == "ship":
        partial = _with_shipped_queries(asked, vectors, most, metric)
    else:
        partial = _by_blocks(asked, vectors, most, metric, block_rows)
    return best_of(partial, queries, [F.asc("distance"), F.asc("vec_id")], k)


def _probed(inside: np.ndarray, probes: int) -> np.ndarray:
    """The changes of steps (rows, tables, probes, cuts) to the buckets nearest to where vectors lie inside their own.

    ``inside`` (rows, tables, cuts) is from 0 to 1.  The own bucket comes first; at most two steps change, by one each.
    """
    cuts = inside.shape[2]
    single = np.vstack([np.eye(cuts, dtype=np.int64), -np.eye(cuts, dtype=np.int64)])
    double = [a + b for i, a in enumerate(single) for b in single[i + 1 :] if np.abs(a + b).sum() == 2 and np.abs(a + b).max() == 1]
    changes = np.vstack([np.zeros((1, cuts), dtype=np.int64), single, *double])
    away = inside**2 @ (changes == -1).T + (1 - inside) ** 2 @ (changes == 1).T
    return changes[np.argsort(away, axis=2, kind="stable")[:, :, :probes]]


def projection_buckets(vector: Column, tables: int, cuts: int, width: float, seed: int, probes: int = 1) -> Column:
    """Bucket keys: ``cuts`` random projections per table, each cut into steps of ``width`` (Datar et al. 2004).

    Each table gives ``probes`` keys in a row, the vector's own bucket and then the nearest others (Lv et al. 2007).
    """

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        values = _matrix(vectors)
        random = np.random.default_rng(seed)
        directions = random.normal(size=(values.shape[1], tables * cuts))
        places = ((values @ directions + random.uniform(0, width, tables * cuts)) / width).reshape(-1, tables, cuts)
        steps = np.floor(places)
        found = []
        for at in range(0, len(values), BLOCK):
            some = slice(at, at + BLOCK)
            asked = steps[some].astype(np.int64)[:, :, None, :]
            if probes > 1:
                asked = asked + _probed(places[some] - steps[some], probes)
            key = np.zeros(asked.shape[:3], dtype=np.int64)
            for c in range(cuts):
                key = key * np.int64(1_000_003) + asked[..., c]
            found += list(key.reshape(len(key), -1))
        return pd.Series(found)

    return keys(vector)


def nearest_approximate(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | None,
    metric: str = "l2",
    tables: int = 16,
    cuts: int = 4,
    width: float = 2.0,
    seed: int = 42,
    block_rows: int = 20_000,
    probes: int = 2,
) -> DataFrame:
    """Nearest vectors among those in the random-projection buckets that the query asks, distances exact.

    Result as ``nearest``.  In each table a query asks its own bucket and the nearest others, ``probes`` in
    all.  A query whose buckets hold fewer than k vectors is answered by the exact search, so every query gets
    its k (or all there are).  ``width`` should be about twice the distance of a near neighbour (2 suits unit
    vectors).  More tables or probes, fewer cuts or wider buckets raise the recall and the cost.  Inside a
    bucket only the k best per query and block leave a task.
    """

    def hashed(df: DataFrame, key: str, per_table: int) -> DataFrame:
        keys = projection_buckets(F.col("vector"), tables, cuts, width, seed, per_table)
        # Read several times below: stored with its keys, a vector is projected once.
        stored = materialize(df.select(key, "vector", keys.alias("keys")), "projected")
        exploded = stored.select(key, "vector", F.posexplode("keys").alias("place", "cell"))
        return exploded.select(F.xxhash64(F.floor(F.col("place") / per_table), "cell").alias("bucket"), key, "vector")

    probes = min(probes, 1 + 2 * cuts + 2 * cuts * (cuts - 1))
    wanted, most = wanted_hits(queries, k)
    found = _by_buckets(hashed(queries, "request_id", probes), hashed(vectors, "vec_id", 1), most, metric, block_rows)
    best = materialize(best_of(found.distinct(), queries, [F.asc("distance"), F.asc("vec_id")], k), "nearest")
    counts = wanted.join(best.groupBy("request_id").count(), "request_id", "left")
    enough = counts.filter(F.coalesce("count", F.lit(0)) >= F.col("k")).select("request_id")
    short = materialize(queries.join(enough, "request_id", "left_anti").select("request_id", "vector", *(["top_k"] if k is None else [])), "short")
    if short.isEmpty():
        return best
    rest = nearest(short, vectors, k, metric, block_rows=block_rows)
    return best.join(enough, "request_id", "left_semi").unionByName(rest)

"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised with its own codebook, so a cell is a pair of centroids.
A query walks the cells in the order of its summed distances to both centroids, with a heap over pairs, until the
cells it has passed hold enough vectors; the vectors of those cells are reranked with exact distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.scale import small_enough
from corpusflow.session import materialize

#: Centroids per half; vectors that codebooks are fitted on at most; of these, vectors that the walk's length is fitted on.
CENTROIDS = 64
MOST_FITTED = 20_000
PROBES = 100
#: Share of the sampled neighbours that the walk must reach; distinct vectors that it must pass at least.
REACHED = 0.95
LEAST = 2000
#: Distinct vectors that one task reranks at a time, and queries that meet them there at a time.
REGION, CROWD = 4096, 32_768


@dataclass
class Index:
    """Codebooks of both halves, the population of all cells, the share a query must pass, and the cells' vectors."""

    halves: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    share: float
    cells: DataFrame

    def regions(self) -> dict[int, tuple[int, int]]:
        """First region and number of regions of each cell: neighbouring cells share one, a crowded cell has several."""
        found, region, held = {}, 0, 0
        for cell in np.flatnonzero(self.sizes).tolist():
            size = int(self.sizes[cell])
            if held and held + size > REGION:
                region, held = region + 1, 0
            parts = -(-size // REGION)
            found[cell] = (region, parts)
            region, held = (region + parts, 0) if parts > 1 else (region, held + size)
        return found


def k_means(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's steps from a fixed draw; no more than there are distinct points."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(3).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = assign(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def assign(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    return ((centroids**2).sum(axis=1)[None, :] - 2 * points @ centroids.T).argmin(axis=1)


def needed_share(matrix: np.ndarray, halves: tuple[np.ndarray, np.ndarray], cells: np.ndarray, cut: int, k: int) -> float:
    """Share of the sample that a walk must pass to reach ``REACHED`` of the ``k`` nearest of sampled probes."""
    sizes = np.bincount(cells, minlength=len(halves[0]) * len(halves[1]))
    shares = []
    for probe in range(min(PROBES, len(matrix))):
        distance = ((matrix - matrix[probe]) ** 2).sum(axis=1)
        distance[probe] = np.inf
        near = cells[np.argsort(distance, kind="stable")[: min(k, len(matrix) - 1)]]
        order = np.array(walk(((matrix[probe, :cut] - halves[0]) ** 2).sum(axis=1), ((matrix[probe, cut:] - halves[1]) ** 2).sum(axis=1), sizes, len(matrix)))
        passed = np.zeros(len(sizes))
        passed[order] = np.cumsum(sizes[order]) / len(matrix)
        shares.append(passed[near])
    return float(np.quantile(np.concatenate(shares), REACHED)) if len(matrix) > 1 else 1.0


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of ``first[i] + second[j]`` until those passed hold ``wanted`` vectors, empty cells left out."""
    rows, columns = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[rows].tolist(), second[columns].tolist()
    heap, reached, found, held = [(a[0] + b[0], 0, 0)], [0] * len(rows), [], 0
    # Row i offers one pair at a time; row i + 1 joins when row i offers its first.
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * len(columns) + columns[j]
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(columns):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def usable(vector: str) -> Column:
    """Vectors that can be compared: not null or empty, all components finite numbers, not all zero."""
    parts = F.col(vector)
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return parts.isNotNull() & (F.size(parts) > 0) & finite & F.exists(parts, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """``vector, ids``: each distinct vector with its ``ids`` smallest ids; no list grows with the number of copies.

    An id given twice with one vector counts once.  Copies are cut to ``ids`` in each task before they are shuffled.
    """
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= ids)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of floats as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(vectors: DataFrame, k: int, centroids: int = CENTROIDS) -> Index | None:
    """Index all distinct vectors (``vector, ids``); codebooks and walk come from at most ``MOST_FITTED`` of them."""
    sample = vectors.select("vector").orderBy(F.xxhash64("vector")).limit(MOST_FITTED)
    points = sample.toArrow().column("vector").combine_chunks()
    if not len(points):
        return None
    matrix = _matrix(points)
    cut = max(1, matrix.shape[1] // 2)
    halves = (k_means(matrix[:, :cut], centroids), k_means(matrix[:, cut:], centroids))

    def cells_of(matrix: np.ndarray) -> np.ndarray:
        return assign(matrix[:, :cut], halves[0]) * len(halves[1]) + assign(matrix[:, cut:], halves[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                cells = pa.array(cells_of(_matrix(part.column("vector"))), pa.int32())
                yield pa.RecordBatch.from_arrays([cells, part.column("vector"), part.column("ids")], names=["cell", "vector", "ids"])

    schema = dict(vectors.dtypes)
    placed = materialize(vectors.mapInArrow(place, f"cell int, vector {schema['vector']}, ids {schema['ids']}"), "cells")
    sizes = np.zeros(len(halves[0]) * len(halves[1]), dtype=np.int64)
    for row in placed.groupBy("cell").count().collect():  # at most centroids squared rows
        sizes[row["cell"]] = row["count"]
    return Index(halves, sizes, needed_share(matrix, halves, cells_of(matrix), cut, k), placed)


def nearest(rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors found for every row that ``queries`` selects: ``query_id, rank, key, score``.

    ``queries`` is a condition on ``id``.  ``score`` is the Euclidean distance in double precision; ties go to the smaller
    id; a row is no neighbour of itself, but other rows with an equal vector are.  A query's cells hold the share of all
    distinct vectors that the index was fitted to, and at least ``LEAST`` (or all).  Null ids, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part; of vectors of several lengths those of the most common length do.
    Rows that repeat an id and vector count once.  Equal vectors are found once, with their k + 1 smallest ids, which
    hold the answer for every query among them.  Other columns are ignored; no rows give no rows.
    """
    base = rows.filter(usable(vector)).select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter("id is not null")
    length = base.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    base = base.filter(F.size("vector") == (length["n"] if length else 0))
    asks = base.filter(queries).distinct()
    kind, id_kind = dict(base.dtypes)["vector"], dict(base.dtypes)["id"]
    index = build(materialize(distinct_vectors(base, k + 1), "vectors"), k)
    if index is None:
        return asks.selectExpr("id as query_id", "cast(null as int) as rank", f"id as `{key}`", "cast(null as double) as score").limit(0)
    regions, (first, second), sizes = index.regions(), index.halves, index.sizes
    wanted, cut = max(LEAST, int(np.ceil(index.share * sizes.sum()))), first.shape[1]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, 64):
                some = part.slice(start, 64)
                matrix = _matrix(some.column("query"))
                a = ((matrix[:, None, :cut] - first[None]) ** 2).sum(axis=2)
                b = ((matrix[:, None, cut:] - second[None]) ** 2).sum(axis=2)
                owner, region, cells = [], [], []
                for i in range(len(matrix)):
                    by_region: dict[int, list[int]] = {}
                    for cell in walk(a[i], b[i], sizes, wanted):
                        begin, parts = regions[cell]
                        for r in range(begin, begin + parts):
                            by_region.setdefault(r, []).append(cell)
                    owner += [i] * len(by_region)
                    region += by_region
                    cells += by_region.values()
                columns = [pa.array(region, pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
                columns += [some.column(name).take(pa.array(owner, pa.int64())) for name in ("number", "query")]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "cells", "number", "query"])

    # Each distinct query vector is asked once, under the smallest id that asks for it.
    distinct = materialize(asks.groupBy("vector").agg(F.min("id").alias("number")).select("number", F.col("vector").alias("query")), "queries")
    visits = materialize(distinct.mapInArrow(visit, f"region int, cells array<int>, number {id_kind}, query {kind}"), "visits")
    plan = rows.sparkSession.createDataFrame([(c, *r) for c, r in regions.items()], "cell int, first int, parts int")
    dealt = index.cells.join(F.broadcast(plan), "cell")  # at most centroids squared rows
    dealt = dealt.select("cell", "vector", "ids", (F.col("first") + F.pmod(F.xxhash64("vector"), "parts")).cast("int").alias("region"))
    # Queries come to a region in crowds; its vectors go once to each crowd, and nowhere if no query visits it.
    crowds = materialize(visits.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("crowds")), "crowds")
    sent = F.broadcast(crowds) if small_enough(crowds) else crowds
    dealt = dealt.join(sent, "region").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")
    visits = visits.join(sent, "region").withColumn("crowd", F.pmod(F.xxhash64("number"), F.col("crowds")).cast("int")).drop("crowds")
    near = dealt.groupBy("region", "crowd").cogroup(visits.groupBy("region", "crowd"))
    found = near.applyInArrow(_rerank(k), f"number {id_kind}, id {id_kind}, score double")
    best = Window.partitionBy("number").orderBy("score", "id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
    # Back to all rows that ask: each leaves out itself and keeps k.
    answers = found.join(distinct, "number").select(F.col("query").alias("vector"), "id", "score")
    paired = asks.select(F.col("id").alias("query_id"), "vector").join(answers, "vector").filter("query_id <> id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = paired.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _rerank(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k + 1 nearest ids of a region's visited cells for each of its queries, by exact distances."""

    def rerank(region: pa.Table, visits: pa.Table) -> pa.Table:
        kind = region.schema.field("ids").type.value_type
        numbers, near_ids, scores = [], [], []
        if region.num_rows and visits.num_rows:
            vectors, ids = _matrix(region.column("vector").combine_chunks()), region.column("ids").to_pylist()
            own = region.column("cell").to_numpy()
            names, place = np.unique(own, return_inverse=True)
            queries = _matrix(visits.column("query").combine_chunks())
            for number, query, cells in zip(visits.column("number").to_pylist(), queries, visits.column("cells").to_pylist()):
                passed = np.flatnonzero(np.isin(names, cells)[place])
                distance = np.sqrt(((vectors[passed] - query) ** 2).sum(axis=1))
                limit = np.partition(distance, k)[k] if len(distance) > k else np.inf
                chosen = np.flatnonzero(distance <= limit)
                near = [(score, one) for i, score in zip(passed[chosen].tolist(), distance[chosen].tolist()) for one in ids[i]]
                for score, one in sorted(near)[: k + 1]:
                    numbers.append(number)
                    near_ids.append(one)
                    scores.append(score)
        return pa.table({"number": pa.array(numbers, kind), "id": pa.array(near_ids, kind), "score": pa.array(scores, pa.float64())})

    return rerank

"""Exact nearest neighbours by distances to pivots: groups of vectors that cannot hold a neighbour are never sent to a query.

Every vector belongs to its nearest pivot and, by its distance to it, to a ring of that pivot.  By the triangle inequality no vector of
a ring is nearer to a query than the query's distance to the pivot lies outside the ring, nor, as the pivot is its nearest, than half
of what that distance exceeds the query's distance to its own pivot.  A query first meets the rings that may be nearest; its k-th
distance there is the bound for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import best_of, wanted_hits
from corpusflow.operators.vectors import BLOCK, CANDIDATES, _best, _matrix, _nearest
from corpusflow.session import materialize

#: Pivots at most, vectors they are fitted on at most, and rounds of that.
MOST_PIVOTS, MOST_FITTED, ROUNDS = 1024, 20_000, 5
#: Vectors of a ring, about; and how many times the neighbours asked for a query meets at first, at least.
RING_ROWS, FIRST = 4096, 8
#: Pairs that a task holds before it keeps the best of each query; vectors of a region, and queries that meet it at a time.
HELD, REGION_ROWS = 2_000_000, 20_000
#: Queries of a crowd at least, where regions are few.
LEAST_CROWD = 256
#: Room for the rounding of distances.
ROOM = 1e-5


def _to_all(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each point to each pivot."""
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample by a few of Lloyd's steps; no more than there are distinct vectors."""
    distinct = np.unique(sample, axis=0)
    pivots = distinct[np.random.default_rng(9).permutation(len(distinct))[:count]]
    for _ in range(ROUNDS):
        near = _to_all(sample, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def pack(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(region of each group, parts of each region): groups in a row that hold about ``rows`` vectors together, or one that holds more."""
    region, held, number = np.zeros(len(sizes), dtype=np.int32), 0, 0
    for group, n in enumerate(sizes):
        if held and held + n > rows:
            number, held = number + 1, 0
        region[group], held = number, held + n
    totals = np.bincount(region, weights=sizes).astype(np.int64)
    return region, np.maximum(1, -(-totals // rows))


def crowds_of(visits: DataFrame, parts: np.ndarray, rows: int) -> DataFrame:
    """(region, crowds): crowds of about ``rows`` queries; of fewer where regions are too few to keep all cores busy."""
    busy = -(-2 * visits.sparkSession.sparkContext.defaultParallelism // max(1, int(parts.sum())))
    count = F.count(F.lit(1))
    crowds = F.greatest(F.ceil(count / rows), F.least(F.ceil(count / LEAST_CROWD), F.lit(busy)))
    return materialize(visits.groupBy("region").agg(crowds.cast("int").alias("crowds")), "crowds")  # a row per region


def _compare_regions(visits: DataFrame, vectors: DataFrame, places: DataFrame, k: int, rows: int) -> DataFrame:
    """The k nearest of each query (request_id, vector, region, buckets) and region among the vectors of these buckets.

    A region's vectors go once to each crowd of about ``rows`` queries that visit it; a bucket of more vectors is cut into parts.
    """

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple] = []
        if len(left) and len(right):
            asked, q, vid, v = left["request_id"].to_numpy(), _matrix(left["vector"]), right["vec_id"].to_numpy(), _matrix(right["vector"])
            met, who = np.concatenate(left["buckets"].to_list()), np.repeat(np.arange(len(left)), [len(b) for b in left["buckets"]])
            order = np.argsort(met, kind="stable")
            met, who = met[order], who[order]
            for bucket, at in right.groupby("bucket").indices.items():
                some = who[np.searchsorted(met, bucket) : np.searchsorted(met, bucket, "right")]
                if len(some):
                    pairs.append(_nearest(asked[some], q[some], vid[at], v[at], k, "l2"))
                if sum(len(p[0]) for p in pairs) > HELD:
                    best = _best(pairs, k)
                    pairs = [tuple(best[c].to_numpy() for c in best.columns)]
        return _best(pairs, k)

    parts = places.select("region", "parts").distinct()
    crowds = crowds_of(visits, np.array([r["parts"] for r in parts.collect()]), rows)
    visits = visits.join(F.broadcast(crowds), "region").join(F.broadcast(parts), "region")
    visits = visits.withColumns({"crowd": F.pmod(F.xxhash64("request_id"), F.col("crowds")), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    vectors = vectors.join(F.broadcast(places), "bucket").join(F.broadcast(crowds), "region")
    vectors = vectors.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.col("parts")), "crowd": F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))})
    key = [F.col(c).cast("long").alias(c) for c in ("region", "part", "crowd")]
    left, right = visits.select(*key, "request_id", "vector", "buckets"), vectors.select(*key, "vec_id", "vector", "bucket")
    key = ["region", "part", "crowd"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, CANDIDATES)


@dataclass
class PivotIndex:
    """Vectors (vec_id, vector) with their ring as ``bucket``, stored; pivots; and a row per ring (pivot, low, high, count)."""

    rows: DataFrame
    pivots: np.ndarray
    rings: pd.DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, most: int = MOST_PIVOTS) -> PivotIndex:
        """Index all vectors, of one length; pivots, about as many as the root of their number, come from a bounded sample."""
        kept = vectors.select("vec_id", "vector").filter("vector is not null")
        sample = kept.select("vector").orderBy(F.xxhash64("vector"), "vec_id").limit(MOST_FITTED).toPandas()["vector"]
        count = kept.count()
        pivots = fit_pivots(_matrix(sample), max(1, min(most, int(np.sqrt(count))))) if len(sample) else np.zeros((0, 0))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    part = frame.iloc[at : at + BLOCK]
                    away = _to_all(_matrix(part["vector"]), pivots)
                    near = away.argmin(axis=1)
                    yield part.assign(pivot=near.astype(np.int32), away=away[np.arange(len(near)), near])

        kind = kept.schema["vector"].dataType.simpleString()
        placed = materialize(kept.mapInPandas(place, f"vec_id {dict(kept.dtypes)['vec_id']}, vector {kind}, pivot int, away double"), "placed")
        ends = placed.groupBy("pivot").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count(F.lit(1)).alias("n"))
        parts = F.ceil(F.col("n") / RING_ROWS)
        step = F.when(F.col("most") > F.col("least"), F.floor((F.col("away") - F.col("least")) / (F.col("most") - F.col("least")) * parts)).otherwise(0)
        ring = F.least(step, parts - 1).cast("long")
        dealt = placed.join(F.broadcast(ends), "pivot")  # a row per pivot
        dealt = dealt.select("vec_id", "vector", "pivot", "away", (F.col("pivot").cast("long") * (1 << 32) + ring).alias("bucket"))
        stored = materialize(dealt, "rings")
        found = stored.groupBy("bucket", "pivot").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n"))
        return cls(stored.select("vec_id", "vector", "bucket"), pivots, found.orderBy("bucket").toPandas())  # a row per RING_ROWS vectors and pivot

    @cached_property
    def size(self) -> int:
        return int(self.rings["n"].sum())

    def visits(self, queries: DataFrame, first: int | None, rows: int = REGION_ROWS) -> DataFrame:
        """(request_id, vector, region, buckets) of the rings a query meets: those that may be nearest until they hold ``first`` vectors;
        or, without it, all others that can hold one within the query's ``reach``.  A query has a row per region of about ``rows`` vectors."""
        sent = queries.sparkSession.sparkContext.broadcast((self.pivots, *(self.rings[c].to_numpy() for c in ("bucket", "pivot", "low", "high", "n"))))
        region, _ = pack(self.rings["n"].to_numpy(), rows)

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, bucket, pivot, low, high, n = sent.value
            for frame in frames:
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at : at + 256]
                    away = _to_all(_matrix(part["vector"]), pivots)
                    own = away[:, pivot]
                    bound = np.maximum(np.maximum(own - high[None, :], low[None, :] - own), (own - away.min(axis=1)[:, None]) / 2)
                    # Rings in the order of their bounds; of equal bounds the nearest pivot's first.
                    order = np.lexsort((own, np.maximum(bound, 0.0)), axis=1)
                    before = np.take_along_axis(np.broadcast_to(n, bound.shape), order, axis=1).cumsum(axis=1)
                    early = np.zeros(bound.shape, dtype=bool)
                    wanted = part["first"].to_numpy()[:, None]
                    np.put_along_axis(early, order, before - np.take_along_axis(np.broadcast_to(n, bound.shape), order, axis=1) < wanted, axis=1)
                    met = early if first is not None else ~early & (bound <= part["reach"].to_numpy()[:, None] + ROOM)
                    row, ring = np.nonzero(met)
                    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(region[ring], prepend=-1) != 0))
                    met = {c: part[c].to_numpy()[row[starts]] for c in ("request_id", "vector")}
                    if len(starts):
                        yield pd.DataFrame({**met, "region": region[ring[starts]], "buckets": np.split(bucket[ring], starts[1:])})

        kind, own = queries.schema["vector"].dataType.simpleString(), dict(queries.dtypes)["request_id"]
        asked = queries if first is None else queries.withColumn("first", F.lit(first)).withColumn("reach", F.lit(0.0))
        return asked.select("request_id", "vector", "first", "reach").mapInPandas(meet, f"request_id {own}, vector {kind}, region int, buckets array<long>")

    def search(self, queries: DataFrame, k: int | None, block_rows: int = REGION_ROWS) -> DataFrame:
        """Exact k nearest vectors per query (request_id, vector[, top_k]): (request_id, rank, vec_id, distance), ties by id.

        As ``vectors.nearest`` by squared Euclidean distance, rounded to six places; without ``k`` each request's own ``top_k``.
        """
        asked = queries.select("request_id", "vector").filter("vector is not null")
        wanted, most = wanted_hits(queries, k)
        if not self.size:
            return queries.sparkSession.createDataFrame([], "request_id long, vec_id long, distance double, rank int")
        first = max(1, FIRST * most)
        region, parts = pack(self.rings["n"].to_numpy(), block_rows)
        places = queries.sparkSession.createDataFrame([(int(b), int(r), int(parts[r])) for b, r in zip(self.rings["bucket"], region)], "bucket long, region int, parts int")
        met = materialize(self.visits(asked, first, block_rows), "visits")
        early = materialize(_compare_regions(met, self.rows, places, most, block_rows), "early")
        order = [F.asc("distance"), F.asc("vec_id")]
        last = best_of(early, wanted.withColumnRenamed("k", "top_k"), order, None).groupBy("request_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("have"))
        reach = asked.join(wanted, "request_id").join(last, "request_id", "left")
        enough = F.coalesce(F.col("have") >= F.col("k"), F.lit(False))
        reach = reach.withColumns({"first": F.lit(first), "reach": F.when(enough, F.sqrt(F.col("far") + 1e-6)).otherwise(F.lit(float("inf")))})
        rest = self.visits(materialize(reach.filter("k > 0").select("request_id", "vector", "first", "reach"), "reach"), None, block_rows)
        late = _compare_regions(materialize(rest, "visits"), self.rows, places, most, block_rows)
        return best_of(early.unionByName(late), queries, order, k)

    def share_met(self, queries: DataFrame, k: int) -> float:
        """Share of all (query, vector) pairs that a search compares, its two rounds together (for reports)."""
        asked = queries.select("request_id", "vector")
        hits = self.search(queries, k).groupBy("request_id").agg(F.max("distance").alias("far"))
        reach = asked.join(hits, "request_id").withColumns({"first": F.lit(FIRST * k), "reach": F.sqrt(F.col("far") + 1e-6)})
        sizes = queries.sparkSession.createDataFrame(self.rings[["bucket", "n"]])
        met = self.visits(asked, FIRST * k).unionByName(self.visits(reach, None)).select(F.explode("buckets").alias("bucket")).join(sizes, "bucket")
        return (met.agg(F.sum("n")).first()[0] or 0) / max(1, queries.count() * self.size)

"""Approximate nearest neighbours by product quantisation: cells of nearest pivots, residual codes, exact distances of a short list.

A vector is its nearest pivot and, for each part of what is left of it, the number of the nearest of 256 code words.  A query meets the
cells of its nearest pivots; there its distances to the points that the codes stand for, one matrix product a cell, rank the vectors.
Only codes are sent to queries, a byte for each part; vectors are fetched for the short list alone and compared exactly.  Cells
are packed into regions: a query goes once to each region that it visits and leaves it with one short list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.pivots import MOST_FITTED, _to_all, crowds_of, fit_pivots, pack
from corpusflow.operators.scale import best_of, top_k, wanted_hits
from corpusflow.operators.vectors import BLOCK, _matrix, distance
from corpusflow.session import materialize

#: Cells at most; components of a part; code words of a part.
MOST_CELLS, PART, WORDS = 1024, 4, 256
#: Vectors of a region, that one task meets at a time, and queries; and those ranked at a time.
CELL_ROWS, CROWD, RANKED = 32_768, 8192, 128
#: Share of the sampled neighbours whose cells a query must meet, sampled probes for it, and the short list per neighbour wanted.
REACHED, PROBES, SHORT = 0.97, 100, 20


@dataclass
class QuantisedIndex:
    """Codes (vec_id, cell, code), stored; the vectors; pivots, code words by part, cell sizes, and the share to be met."""

    codes: DataFrame
    vectors: DataFrame
    pivots: np.ndarray
    words: list[np.ndarray]
    sizes: np.ndarray
    share: float

    @classmethod
    def build(cls, vectors: DataFrame, k: int = 10, most: int = MOST_CELLS) -> QuantisedIndex:
        """Index all vectors, of one length; pivots, code words and the share a query meets come from a bounded sample."""
        kept = vectors.select("vec_id", "vector").filter("vector is not null")
        count = kept.count()
        found = kept.select("vector").orderBy(F.xxhash64("vector"), "vec_id").limit(MOST_FITTED).toPandas()["vector"]
        sample = _matrix(found) if len(found) else np.zeros((1, 1))
        pivots = fit_pivots(sample, max(1, min(most, int(np.sqrt(count)))))
        cells = _to_all(sample, pivots).argmin(axis=1)
        rest = sample - pivots[cells]
        edges = list(range(0, sample.shape[1], PART))
        words = [fit_pivots(rest[:, e : e + PART], WORDS) for e in edges]

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), BLOCK):
                    part = frame.iloc[at : at + BLOCK]
                    matrix = _matrix(part["vector"])
                    cell = _to_all(matrix, pivots).argmin(axis=1)
                    left = matrix - pivots[cell]
                    code = np.stack([_to_all(left[:, e : e + PART], w).argmin(axis=1) for e, w in zip(edges, words)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

        stored = materialize(kept.mapInPandas(encode, f"vec_id {dict(kept.dtypes)['vec_id']}, cell int, code binary"), "codes")
        sizes = np.zeros(len(pivots), dtype=np.int64)
        for row in stored.groupBy("cell").count().collect():  # a row per cell
            sizes[row["cell"]] = row["count"]
        return cls(stored, kept, pivots, words, sizes, _needed_share(sample, pivots, cells, k))

    def search(self, queries: DataFrame, k: int | None) -> DataFrame:
        """About the k nearest vectors per query (request_id, vector[, top_k]): (request_id, rank, vec_id, distance), ties by id.

        Distances (squared Euclidean, rounded to six places) are exact; a neighbour may be missed.  Without ``k`` each
        request's own ``top_k`` counts.
        """
        wanted, most = wanted_hits(queries, k)
        asked = queries.select("request_id", "vector").filter("vector is not null")
        if not self.sizes.sum() or not most:
            return queries.sparkSession.createDataFrame([], "request_id long, vec_id long, distance double, rank int")
        pivots, words, sizes, least = self.pivots, self.words, self.sizes, max(most * SHORT, int(np.ceil(self.share * self.sizes.sum())))
        short = most * SHORT

        region, parts = pack(sizes, CELL_ROWS)

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 512):
                    part = frame.iloc[at : at + 512]
                    order = np.argsort(_to_all(_matrix(part["vector"]), pivots), axis=1, kind="stable")
                    held = sizes[order]
                    row, place = np.nonzero((held.cumsum(axis=1) - held < least) & (held > 0))
                    cell = order[row, place].astype(np.int32)
                    by_region = np.lexsort((cell, region[cell], row))
                    row, cell = row[by_region], cell[by_region]
                    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(region[cell], prepend=-1) != 0))
                    if not len(starts):
                        continue
                    yield pd.DataFrame(
                        {
                            "request_id": part["request_id"].to_numpy()[row[starts]],
                            "vector": part["vector"].to_numpy()[row[starts]],
                            "region": region[cell[starts]],
                            "cells": np.split(cell, starts[1:]),
                        }
                    )

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"request_id": [], "vec_id": [], "about": []})
            right = right.sort_values(["cell", "vec_id"])
            ids, cell, out = right["vec_id"].to_numpy(), right["cell"].to_numpy(), []
            code = np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(right), -1)
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = np.append(starts[1:], len(cell))
            points = np.hstack([w[code[:, j]] for j, w in enumerate(words)])
            squares = (points * points).sum(axis=1)
            for at in range(0, len(left), RANKED):
                some = left.iloc[at : at + RANKED]
                asked, sums = _matrix(some["vector"]), np.full((len(some), len(ids)), np.inf)
                visits = np.repeat(np.arange(len(some)), [len(c) for c in some["cells"]])
                visited = np.concatenate(some["cells"].to_list())
                order = np.argsort(visited, kind="stable")
                visits, visited = visits[order], visited[order]
                for start, end in zip(starts, ends):
                    who = visits[np.searchsorted(visited, cell[start]) : np.searchsorted(visited, cell[start], "right")]
                    if len(who):
                        rest = asked[who] - pivots[cell[start]]
                        away = (rest * rest).sum(axis=1)[:, None] + squares[start:end] - 2 * rest @ points[start:end].T
                        sums[who, start:end] = np.round(away, 9)  # equal codes are equally near
                best = np.argpartition(sums, short - 1, axis=1)[:, :short] if len(ids) > short else np.tile(np.arange(len(ids)), (len(some), 1))
                about = np.take_along_axis(sums, best, axis=1)
                row, place = np.nonzero(~np.isinf(about))
                out.append(pd.DataFrame({"request_id": some["request_id"].to_numpy()[row], "vec_id": ids[best[row, place]], "about": about[row, place]}))
            return pd.concat(out)

        own, kind = dict(queries.dtypes)["request_id"], queries.schema["vector"].dataType.simpleString()
        visits = materialize(asked.mapInPandas(meet, f"request_id {own}, vector {kind}, region int, cells array<int>"), "visits")
        # A region's codes go once to each crowd of the queries that visit it; a cell of more vectors is several parts of its region.
        places = queries.sparkSession.createDataFrame([(c, int(r), int(parts[r])) for c, r in enumerate(region)], "cell int, region int, parts int")
        crowds = crowds_of(visits, parts, CROWD)
        visits = visits.join(F.broadcast(crowds), "region").withColumn("crowd", F.pmod(F.xxhash64("request_id"), F.col("crowds")).cast("int")).drop("crowds")
        visits = visits.join(F.broadcast(places.select("region", "parts").distinct()), "region")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        codes = self.codes.join(F.broadcast(places), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        codes = codes.join(F.broadcast(crowds), "region").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")
        key = ["region", "part", "crowd"]
        listed = visits.groupBy(*key).cogroup(codes.groupBy(*key)).applyInPandas(nearest, f"request_id {own}, vec_id {dict(self.codes.dtypes)['vec_id']}, about double")
        listed = materialize(top_k(listed, ["request_id"], [F.asc("about"), F.asc("vec_id")], short, "place").select("request_id", "vec_id"), "short")
        pairs = listed.join(self.vectors, "vec_id").join(asked.withColumnRenamed("vector", "asked"), "request_id")
        scored = pairs.select("request_id", "vec_id", F.round(distance(F.col("asked"), F.col("vector")), 6).alias("distance"))
        return best_of(scored, queries, [F.asc("distance"), F.asc("vec_id")], k)


def _needed_share(sample: np.ndarray, pivots: np.ndarray, cells: np.ndarray, k: int) -> float:
    """Share of the sample that a query must meet, nearest cells first, to reach ``REACHED`` of its ``k`` nearest."""
    sizes, shares = np.bincount(cells, minlength=len(pivots)), []
    for probe in range(min(PROBES, len(sample))):
        away = ((sample - sample[probe]) ** 2).sum(axis=1)
        away[probe] = np.inf
        order = np.argsort(_to_all(sample[probe : probe + 1], pivots)[0], kind="stable")
        passed = np.zeros(len(pivots))
        passed[order] = sizes[order].cumsum() / len(sample)
        shares.append(passed[cells[np.argsort(away, kind="stable")[: min(k, len(sample) - 1)]]])
    return float(np.quantile(np.concatenate(shares), REACHED)) if len(sample) > 1 else 1.0

"""Where user code plugs in: encoders, scorers and indexers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encoder(encode: Callable[[list[str]], np.ndarray]) -> Callable:
    """Wrap ``encode(texts) -> matrix`` as a column function giving ``array<float>``."""

    @F.pandas_udf("array<float>")
    def column(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(encode(texts.tolist()), dtype=np.float32)
        return pd.Series(list(matrix))

    return column


def scorer(score: Callable[[list[str], list[str]], np.ndarray]) -> Callable:
    """Wrap ``score(queries, candidates) -> vector`` as a column function of two text columns."""

    @F.pandas_udf("double")
    def column(queries: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(score(queries.tolist(), candidates.tolist()), dtype=np.float64))

    return column


def router(df: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user step to messages; it sees and returns a DataFrame."""
    return df.transform(apply)


class Indexer(Protocol):
    """A user index: both steps are DataFrame to DataFrame."""

    def build(self, chunks: DataFrame) -> DataFrame:
        """Index rows from (doc_id, offset, text)."""

    def search(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(request_id, rank, doc_id, offset, ...) from (request_id, text)."""


def run_indexer(indexer: Indexer, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return indexer.search(indexer.build(chunks), queries, k)

"""Messages: block and dispatch by kind, statistics, reduce of partial results, request/response pairing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import best_of


def block(messages: DataFrame, kinds: Sequence[str], column: str = "kind") -> DataFrame:
    """Drop messages of the listed kinds; with an empty list nothing is dropped.  Works on streams."""
    if not kinds:
        return messages
    return messages.filter(F.col(column).isNull() | ~F.col(column).isin(list(kinds)))


def kind_stats(messages: DataFrame, column: str = "kind") -> DataFrame:
    """Number of messages per kind."""
    return messages.groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("messages"))


def dispatch(messages: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]], column: str = "kind") -> dict[str, DataFrame]:
    """Give each handler the messages of its kind; messages of other kinds are dropped."""
    return {kind: handler(messages.filter(F.col(column) == kind)) for kind, handler in handlers.items()}


def reduce_parts(parts: DataFrame, num_part: int, k: int | None, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge partial results once all ``num_part`` distinct parts of a request have arrived.

    ``parts`` is (request_id, part, doc_id, offset, score); a part without hits arrives as one row with a
    null doc_id.  Returns the merged top k (highest score per chunk, ranked again) and the requests still
    pending with the number of parts they have.  Without ``k`` each request's own ``top_k`` counts, from ``requests``
    (request_id, top_k) or, without them, from the parts.
    """
    arrived = parts.groupBy("request_id", "part").agg(F.count(F.lit(1)).alias("n"))
    arrived = arrived.groupBy("request_id").agg(F.count(F.lit(1)).alias("arrived"))
    hits = parts.filter("doc_id IS NOT NULL").groupBy("request_id", "doc_id", "offset").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("offset")]
    # The top k comes first: joining the completeness of a request then moves k rows per request only.
    best = best_of(hits, parts if requests is None else requests, order, k)
    complete = arrived.filter(F.col("arrived") >= num_part).select("request_id")
    merged = best.join(complete, "request_id", "left_semi")
    return merged.select("request_id", "rank", "doc_id", "offset", "score"), arrived.filter(F.col("arrived") < num_part)


def rendezvous(
    requests: DataFrame, responses: DataFrame, key: str = "request_id", order: Sequence[str] = (), within: Sequence[str] = ()
) -> DataFrame:
    """Pair each request with the rows of its response, whichever came first; each pair once.

    ``top_k`` and the query text come from the request, the hits from the response.  Of repeated messages the first
    stays: of requests the first per key by ``order`` (by all other columns if not given), of response rows one per
    (key, *``within``), so a response of several hits keeps them all when ``within`` names what tells them
    apart, such as the rank.
    """
    asked = first_message(requests, [key], order)
    return asked.join(first_message(responses, [key, *within], ()), key)


def first_message(messages: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest message per key by ``order``, then by all other columns; combined map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in messages.columns if c not in (*keys, *order)]
    if not rest and not order:
        return messages.distinct()
    first = messages.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return first.select(*keys, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])

"""Keyed state across micro-batches: pairing requests with all rows of their responses, and merging partial results.

State is kept per request in Spark's state store, and a timer in event time frees it: a request that nothing was heard of for the
time-out is forgotten.  Messages older than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps lists, maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state where these processors can."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _seconds(timeout: str) -> int:
    number, unit = timeout.split()
    return int(timedelta(**{unit if unit.endswith("s") else f"{unit}s": int(number)}).total_seconds())


class _Timed(StatefulProcessor):
    """A processor whose state ends ``timeout`` milliseconds after the key's last message."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def _postpone(self, latest: int) -> None:
        """One timer per key, at its latest message's time plus the time-out."""
        until = latest + self.timeout
        timers = list(self.handle.listTimers())
        if any(t >= until for t in timers):
            return
        for old in timers:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)

    def close(self) -> None:
        pass


class _Pairing(_Timed):
    """Per request: its first message, response rows that wait for it, and which rows were paired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "at long, body string")
        self.waiting = handle.getListState("waiting", "at long, part string, body string")
        self.paired = handle.getMapState("paired", "part string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["at", "body"], kind="stable")
        asked = self.request.get() if self.request.exists() else None
        first = arrived[arrived["part"].isna()]
        responses = [tuple(r) for r in arrived.loc[arrived["part"].notna(), ["at", "part", "body"]].itertuples(index=False)]
        if asked is None and len(first):
            asked = (int(first["at"].iloc[0]), first["body"].iloc[0])
            self.request.update(asked)
            if self.waiting.exists():
                responses = [tuple(r) for r in self.waiting.get()] + responses
                self.waiting.clear()
        out = []
        for at, part, body in responses:
            if asked is None:
                self.waiting.appendValue((int(at), part, body))
            elif abs(at - asked[0]) <= self.timeout and not self.paired.containsKey((part,)):
                self.paired.updateValue((part,), (int(at),))
                out.append((key[0], asked[1], body))
        self._postpone(int(arrived["at"].max()))
        yield pd.DataFrame(out, columns=["key", "request", "response"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.request.clear()
        self.waiting.clear()
        self.paired.clear()
        yield pd.DataFrame([], columns=["key", "request", "response"], dtype=object)


def _milliseconds(ts: str) -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def rendezvous(
    requests: DataFrame, responses: DataFrame, timeout: str, within: Sequence[str], ts: str = "ts", key: str = "request_id"
) -> DataFrame:
    """Pair each request of a stream with every row of its response, whichever comes first, each row once.

    A response has a row per hit; ``within`` names the columns that tell them apart, such as the rank.  Of repeated
    requests the first counts, of repeated response rows the first of each (key, *``within``).  Rows more than ``timeout``
    away from the request in event time are not paired, and a request's state ends so long after its last message.
    Result: the key, the request's other columns, the response's.
    """
    use_keyed_state(requests.sparkSession)
    kind = requests.schema[key].dataType
    sides = {"request": [c for c in requests.columns if c not in (key, ts)], "response": [c for c in responses.columns if c not in (key, ts)]}

    def messages(rows: DataFrame, columns: list[str], part: F.Column) -> DataFrame:
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
        return rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), _milliseconds(ts).alias("at"), part.cast("string").alias("part"), body.alias("body"))

    asked = messages(requests, sides["request"], F.lit(None))
    heard = messages(responses, sides["response"], F.to_json(F.struct(*within), {"ignoreNullFields": "false"}))
    both = asked.unionByName(heard).filter("key is not null and at is not null").withWatermark("ts", timeout)
    schema = T.StructType([T.StructField("key", kind), T.StructField("request", T.StringType()), T.StructField("response", T.StringType())])
    paired = both.groupBy("key").transformWithStateInPandas(_Pairing(_seconds(timeout) * 1000), schema, "Append", "EventTime")
    out = [F.col("key").alias(key)]
    for side, frame in (("request", requests), ("response", responses)):
        fields = T.StructType([frame.schema[c] for c in sides[side]])
        out += [F.from_json(side, fields)[c].alias(c) for c in sides[side]]
    return paired.select(*out)


class _Reducing(StatefulProcessor):
    """Per request: the parts that have arrived, the best score of each chunk so far, whether it was answered, and its timer.

    All of it is one value, read and written once a micro-batch: every call to the state store is a message to another process.
    """

    def __init__(self, timeout: int, num_part: int, k: int | None):
        self.timeout, self.num_part, self.k = timeout, num_part, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "body string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [row for frame in rows for row in zip(*(frame[c].tolist() for c in ("part", "doc_id", "offset", "score", "at", "top_k")))]
        held = json.loads(self.held.get()[0]) if self.held.exists() else {"until": None, "answered": False, "parts": [], "best": []}
        # One timer per key, at its latest message's time plus the time-out.
        until = max(int(row[4]) for row in arrived) + self.timeout
        if held["until"] is None or until > held["until"]:
            if held["until"] is not None:
                self.handle.deleteTimer(held["until"])
            self.handle.registerTimer(until)
            held["until"] = until
        if held["answered"]:
            self.held.update((json.dumps(held),))
            return
        parts = dict.fromkeys([*held["parts"], *(row[0] for row in arrived)])
        best = {(doc, offset): score for doc, offset, score in held["best"]}
        for _, doc, offset, score, _, _ in arrived:
            if pd.isna(doc) or pd.isna(offset):
                continue
            place, score = (int(doc), int(offset)), float(score)
            if place not in best or (score == score and not best[place] >= score):
                best[place] = score
        if len(parts) < self.num_part:
            self.held.update((json.dumps(held | {"parts": list(parts), "best": [(*place, score) for place, score in best.items()]}),))
            return
        k = self.k if self.k is not None else int(max(row[5] for row in arrived))
        ranked = sorted((-score, *place) for place, score in best.items())[:k]
        self.held.update((json.dumps({"until": held["until"], "answered": True, "parts": [], "best": []}),))
        yield pd.DataFrame([(key[0], rank, doc, offset, -less, None) for rank, (less, doc, offset) in enumerate(ranked, 1)], columns=MERGED, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.held.get()[0])
        self.held.clear()
        missing = [] if held["answered"] else [(key[0], None, None, None, None, len(held["parts"]))]
        yield pd.DataFrame(missing, columns=MERGED, dtype=object)


MERGED = ["request_id", "rank", "doc_id", "offset", "score", "arrived"]


def reduce_parts(parts: DataFrame, num_part: int, k: int | None, timeout: str, ts: str = "ts") -> DataFrame:
    """Merge partial results of a stream once all ``num_part`` distinct parts of a request have arrived, in whichever micro-batches.

    ``parts`` is (request_id, part, doc_id, offset, score, ts[, top_k]); a part without hits is one row with a null doc_id, and a
    part's rows, one message, come in one micro-batch.
    Result: (request_id, rank, doc_id, offset, score, arrived): the best ``k`` hits (or the request's own ``top_k``) of a
    complete request, ``arrived`` null; and, ``timeout`` after its last message, one row for a request that stayed
    incomplete, with ``arrived`` parts and the rest null.  Parts of an answered request that come again are ignored.
    """
    use_keyed_state(parts.sparkSession)
    own = F.col("top_k").cast("int") if k is None else F.lit(k)
    rows = parts.select("request_id", F.col("part").cast("string").alias("part"), "doc_id", "offset", "score", F.col(ts).alias("ts"), _milliseconds(ts).alias("at"), own.alias("top_k"))
    rows = rows.filter("request_id is not null and part is not null and at is not null").withWatermark("ts", timeout)
    kind = parts.schema["request_id"].dataType.simpleString()
    schema = f"request_id {kind}, rank int, doc_id long, offset int, score double, arrived long"
    return rows.groupBy("request_id").transformWithStateInPandas(_Reducing(_seconds(timeout) * 1000, num_part, k), schema, "Append", "EventTime")

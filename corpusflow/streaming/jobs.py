"""Streaming forms of the flows.  Sinks write one folder per micro-batch, so a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusflow.operators import chunks as C
from corpusflow.operators import docstore, fulltext, rerank, routing
from corpusflow.operators.scale import greatest
from corpusflow.session import freed_shuffles


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``per_batch`` bounds the files of a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; ``once`` stops after the rows available now."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def ingest(messages: DataFrame, path: str, checkpoint: str, once: bool = True, **analysis) -> StreamingQuery:
    """Index messages (kind, doc_id, text, seq): each micro-batch adds a segment to the full-text index and writes to the store.

    Segments are merged as they come together, so their number grows with the logarithm of the number of micro-batches; a batch that
    the index has already, after a failure, changes nothing.  Of a document's writes the one with the highest ``seq`` wins, in whichever order and batches they come (of equal
    ``seq`` in one batch the greatest text, in several batches the last); index and store choose alike.
    """
    docs = routing.block(messages, ["train"]).select("doc_id", "text", "seq")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = greatest(batch, ["doc_id"], "seq", "text").select("doc_id", "text", "seq")
        with freed_shuffles(spark):
            write_batch(last, f"{path}/store", batch_id)
        # The index reads the texts from the store: each key once, a document without number has no key.
        stored = spark.read.schema(last.schema).parquet(f"{path}/store/batch_id={batch_id}").filter("doc_id is not null")
        chunks = C.unary_chunks(stored, "text", "seq")
        terms = chunks.select("doc_id", "offset", fulltext.analyze(F.col("text"), **analysis).alias("terms"), "seq")
        fulltext.TextIndex(spark, f"{path}/fulltext").add_terms(terms, "seq", batch_id)

    return start(docs, handle, checkpoint, once)


def read_index(spark: SparkSession, path: str) -> tuple[fulltext.TextIndex, DataFrame]:
    """(full-text index, document store (doc_id, text)), each with the newest write per key."""
    writes = spark.read.parquet(f"{path}/store").withColumn("at", F.struct("seq", "batch_id"))
    store = docstore.upsert(None, writes.select("doc_id", "text", "at"), seq="at").select("doc_id", "text")
    return fulltext.TextIndex(spark, f"{path}/fulltext"), store


def block(messages: DataFrame, kinds: Sequence[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Filter a message stream by kind into a Parquet folder."""
    kept = routing.block(messages, kinds)
    writer = kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search(
    queries: DataFrame,
    index: fulltext.TextIndex | str,
    k: int | None,
    path: str,
    checkpoint: str,
    match: str = "all",
    once: bool = True,
) -> StreamingQuery:
    """Search a stream of (request_id, text[, top_k]) in a standing index; the best hits of a request are in its micro-batch.

    A micro-batch reads the postings of its own terms.  With a path in place of an index each micro-batch searches the newest
    state of the index there, so documents that come in between are found by later requests.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        asked = batch.persist()
        newest = fulltext.TextIndex(batch.sparkSession, index) if isinstance(index, str) else index
        try:
            write_batch(fulltext.search(newest, asked, k, match), path, batch_id)
        finally:
            asked.unpersist()

    return start(queries, handle, checkpoint, once)


def rendezvous(requests: DataFrame, responses: DataFrame, timeout: str, ts: str = "ts", key: str = "request_id") -> DataFrame:
    """Pair two message streams by key, whichever comes first, each pair once.

    Messages whose partner is more than ``timeout`` away in event time are not paired; that bound and the
    watermarks let Spark drop old state.
    """
    left = requests.withWatermark(ts, timeout).dropDuplicatesWithinWatermark([key])
    right = responses.withWatermark(ts, timeout).dropDuplicatesWithinWatermark([key])
    right = right.withColumnsRenamed({key: f"_{key}", ts: f"response_{ts}"})
    bound = F.expr(f"INTERVAL {timeout}")
    near = F.col(f"response_{ts}").between(F.col(ts) - bound, F.col(ts) + bound)
    return left.join(right, (F.col(key) == F.col(f"_{key}")) & near).drop(f"_{key}")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _moments(features: Sequence[str], label: str) -> dict[str, Column]:
    """Sums of products of (1, features, label): all a least-squares fit needs."""
    terms = {"one": F.lit(1.0), **{f: F.col(f) for f in features}, "label": F.col(label)}
    names = list(terms)
    return {f"{a}*{b}": F.sum(terms[a] * terms[b]) for i, a in enumerate(names) for b in names[i:]}


def solve(moments: Mapping[str, float], features: Sequence[str], reg: float = 1e-3) -> tuple[dict[str, float], float]:
    """(weights, intercept) of the ridge fit from summed moments: a system of a few unknowns."""
    names = ["one", *features]

    def moment(a: str, b: str) -> float:
        return moments[f"{a}*{b}"] if f"{a}*{b}" in moments else moments[f"{b}*{a}"]

    n = moment("one", "one")
    system = np.array([[moment(a, b) for b in names] for a in names]) / n
    # The batch fit penalises in units of the label's deviation; so does this one.
    deviation = np.sqrt(max(moment("label", "label") / n - (moment("one", "label") / n) ** 2, 0.0))
    system[1:, 1:] += (reg / deviation if deviation > 0 else reg) * np.eye(len(features))
    solution = np.linalg.lstsq(system, np.array([moment(a, "label") for a in names]) / n, rcond=None)[0]
    return dict(zip(features, solution[1:].tolist())), float(solution[0])


def train_scorer(
    pairs: DataFrame,
    path: str,
    checkpoint: str,
    features: Sequence[str] = rerank.FEATURES,
    once: bool = True,
    stats: DataFrame | None = None,
    reg: float = 1e-3,
) -> StreamingQuery:
    """Keep the rerank scorer up to date from a stream of (query, candidate, label).

    A micro-batch adds its moments to those of all before it, one row, and the weights are solved from the sums,
    which equals a refit on all pairs (``rerank.fit_scorer``) without reading them again.  Only the rows of the last two
    micro-batches are kept: one that is run again adds to the row before its own and replaces what it wrote.  ``path/status``
    gets one row per micro-batch: (step, status, examples, intercept, weights).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = _moments(features, "label")
        sums = rerank.pair_features(batch, stats).agg(*[F.coalesce(v, F.lit(0.0)).alias(name) for name, v in parts.items()]).first().asDict()
        earlier = _last_row(spark, f"{path}/moments", batch_id)
        if earlier:
            sums = {name: value + earlier[name] for name, value in sums.items()}
        write_batch(spark.createDataFrame([tuple(sums.values())], ", ".join(f"`{name}` double" for name in sums)), f"{path}/moments", batch_id)
        _forget(spark, f"{path}/moments", batch_id - 1)
        if not sums["one*one"]:
            return
        weights, intercept = solve(sums, features, reg)
        status = spark.createDataFrame(
            [(batch_id, "SUCCESS", int(sums["one*one"]), intercept, weights)],
            "step long, status string, examples long, intercept double, weights map<string,double>",
        )
        write_batch(status, f"{path}/status", batch_id)

    return start(pairs, handle, checkpoint, once)


def _last_row(spark: SparkSession, path: str, before: int) -> dict | None:
    """The row of the last micro-batch before one, in a folder of rows by micro-batch."""
    try:
        row = spark.read.parquet(path).filter(F.col("batch_id") < before).orderBy(F.desc("batch_id")).first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Delete the folders of micro-batches before one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) < before:
            files.delete(found.getPath(), True)


def latest_scorer(spark: SparkSession, path: str) -> tuple[dict[str, float], float]:
    """(weights, intercept) after the last micro-batch; FileNotFoundError before the first."""
    try:
        row = spark.read.parquet(f"{path}/status").orderBy(F.desc("step")).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no scorer trained in {path}") from error
    return row["weights"], row["intercept"]

"""Document store: last write wins, lookups in request order, and a stored form that prunes buckets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.scale import salted_join
from corpusflow.session import materialize


#: Keys of a row group that its Bloom filter is laid out for; keys of a lookup that are compared one by one with the filters.
FILTERED_KEYS, COMPARED_KEYS = 50_000, 200


def upsert(store: DataFrame | None, added: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """One row per key: the row with the highest ``seq``.  Old and new rows have the same columns.

    Combined map-side, so a key written many times sends one row per task.
    """
    rows = added if store is None else store.unionByName(added)
    values = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("_d"))
    return latest.select(key, *[F.col(f"_d.{c}").alias(c) for c in values])


def lookup(requests: DataFrame, store: DataFrame, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """Every requested key, duplicates kept, with its document and ``found``.

    ``strict`` raises KeyError when a key is missing.  Keys asked for very often are spread over tasks.
    """
    marked = store.withColumn("found", F.lit(True))
    rows = salted_join(requests, marked, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        missing = rows.filter("NOT found").select(key).first()
        if missing:
            raise KeyError(missing[0])
    return rows


def request_keys(requests: DataFrame, keys: str = "keys", key: str = "doc_id") -> DataFrame:
    """Array of keys per request to rows (request_id, position, key); positions keep the request order."""
    return requests.select("request_id", F.posexplode(keys).alias("position", key))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(docs: DataFrame, path: str, key: str = "doc_id", buckets: int = 64, mode: str = "append") -> None:
    """Parquet partitioned by key bucket.

    The rows of a bucket are dealt to enough tasks that all shuffle partitions write: one file per bucket where there
    are as many buckets as partitions, more where a job has more partitions.  Files are sorted by key and carry Bloom
    filters of it, so a lookup skips the row groups that cannot hold its keys.
    """
    rows = docs.withColumn("bucket", bucket_of(F.col(key), buckets))
    parts = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(-(-parts // buckets)))
    sorted_ = rows.repartition(parts, "bucket", salt).sortWithinPartitions("bucket", key)
    writer = sorted_.write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", FILTERED_KEYS)
    writer.partitionBy("bucket").parquet(path)


def read_store(spark: SparkSession, path: str, seq: str | None = "seq", key: str = "doc_id") -> DataFrame:
    """The stored documents; with ``seq`` only the latest write of each key."""
    rows = spark.read.parquet(path)
    return rows if seq is None else upsert(None, rows, key, seq)


def get(spark: SparkSession, path: str, keys: list[int], buckets: int = 64, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """A few documents by key, reading only their buckets, and of these the row groups whose key filters let one of them pass."""
    numbers = spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in keys]) if keys else F.array().cast("array<long>")).alias("key"))
    wanted = sorted(r[0] for r in numbers.select(bucket_of(F.col("key"), buckets)).distinct().collect())  # few keys are given
    # Spark turns a long list into its ends only, single comparisons meet the filters.
    one = [F.col(key) == k for k in keys]
    among = reduce(or_, one) if 0 < len(one) <= COMPARED_KEYS else F.col(key).isin(keys)
    rows = spark.read.parquet(path).filter(F.col("bucket").isin(wanted) & among)
    return upsert(None, rows.drop("bucket"), key, seq)


def joint_search(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Search hits with their stored documents attached, and ``found``; a hit whose document is not stored keeps its row.

    The hits are stored first: with a known size, Spark ships the few hits to the documents and does not
    shuffle the documents to the hits.  The documents found are then joined back to the hits.
    """
    stored = materialize(hits, "hits")
    wanted = docs.join(stored.select("doc_id").distinct(), "doc_id", "left_semi")
    return lookup(stored, materialize(wanted, "documents"))

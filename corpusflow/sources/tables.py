"""Tables in and out: projected scans, the id contract, shuffled scans, positions, inserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.scale import with_position


def scan(df: DataFrame, id_column: str, data_columns: Sequence[str], limit: int = -1) -> DataFrame:
    """``SELECT id, columns ... ORDER BY id [LIMIT n]``; a limit that is not positive means all rows."""
    rows = df.select(id_column, *data_columns).orderBy(id_column)
    return rows.limit(limit) if limit > 0 else rows


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: tuple[str, int, int, int] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read: a whole table, in parallel over an id range, or one query.

    ``partition`` is (column, lower, upper, partitions); each partition is fetched in chunks of
    ``fetch_size`` rows.  A query cannot be partitioned, so give it as a table ``(query) alias`` for that.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size)}
    options["dbtable" if table else "query"] = table or query
    if partition:
        if query:
            raise ValueError("a query cannot be partitioned; pass it as a table: '(query) alias'")
        column, lower, upper, parts = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(parts),
        }
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, truncate: bool = False, batch_size: int = 10_000) -> None:
    """Append rows to a database table; ``truncate`` empties it first and keeps its definition."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size)
    if truncate:
        writer.mode("overwrite").option("truncate", "true").save()
    else:
        writer.mode("append").save()


def insert_rows(df: DataFrame, path: str, truncate: bool = False) -> None:
    """Append rows to a Parquet table, or replace its rows."""
    df.write.mode("overwrite" if truncate else "append").parquet(path)


def fetch(df: DataFrame, key: str, size: int, where: str | None = None) -> tuple[list[str], DataFrame]:
    """Column names of a result, and the result in pages: its rows with ``page`` and ``slot``, by order of ``key``.

    A page holds ``size`` rows, the last one the rest; ``page = n`` then reads one chunk.  ``key`` must be unique.
    """
    rows = df.filter(where) if where else df
    numbered = with_position(rows, [key], "_position")
    pages = numbered.withColumns({"page": F.floor(F.col("_position") / size), "slot": F.pmod("_position", F.lit(size))})
    return rows.columns, pages.drop("_position")


def id_contract(df: DataFrame, id_column: str, start: int = 1) -> DataFrame:
    """One row telling whether the ids are exactly ``start, start+1, ...``, each once.

    Columns n, min_id, max_id, n_distinct, n_missing, ok; n_missing counts the ids of ``start .. start + n - 1``
    that are not there.  Counts are combined per id first; for an empty table ok is true.
    """
    rows = F.lit(df.agg(F.count(F.lit(1))).first()[0])
    per_id = df.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    totals = per_id.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
        F.count("id").alias("n_distinct"),
        F.count_if(F.col("id").between(start, F.lit(start) + rows - 1)).alias("n_inside"),
    )
    top = F.lit(start) + F.col("n") - 1
    dense = (F.col("n") == F.col("n_distinct")) & (F.col("min_id") == start) & (F.col("max_id") == top)
    return totals.withColumn("n_missing", F.col("n") - F.col("n_inside")).drop("n_inside").withColumn(
        "ok", (F.col("n") == 0) | F.coalesce(dense, F.lit(False))
    )


def id_violations(df: DataFrame, id_column: str, start: int = 1) -> DataFrame:
    """The ids that break the contract: (id, problem) with missing, duplicate or outside."""
    n = df.count()
    per_id = df.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    expected = df.sparkSession.range(start, start + n)
    outside = F.col("id").isNull() | ~F.col("id").between(start, start + n - 1)
    bad = per_id.select(
        "id", F.when(outside, "outside").when(F.col("c") > 1, "duplicate").alias("problem")
    ).filter("problem is not null")
    missing = expected.join(per_id, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    return bad.unionByName(missing)


def check_ids(df: DataFrame, id_column: str, start: int = 1) -> DataFrame:
    """``df`` unchanged, or ValueError before anything is read from it."""
    report = id_contract(df, id_column, start).first()
    if not report["ok"]:
        bad = id_violations(df, id_column, start).orderBy("id").first()
        raise ValueError(
            f"column {id_column!r} must hold the ids from {start} on, each once; "
            f"first violation: {bad['problem']} id {bad['id']}"
        )
    return df


def select_all(df: DataFrame, key: str | None = None, random: bool = True, seed: int | None = None) -> DataFrame:
    """All rows; in random order unless ``random`` is off.

    With a key and a seed the order is by md5(key, seed): random, but the same on every run.
    """
    if not random:
        return df
    if key is None:
        return df.orderBy(F.rand(seed))
    return df.orderBy(*shuffle_order(key, seed or 0))


def shuffle_order(key: str, seed: int):
    return [F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def shuffled_positions(df: DataFrame, key: str, seed: int = 0, name: str = "position") -> DataFrame:
    """Rows with their position in the reproducible shuffle."""
    return with_position(df, shuffle_order(key, seed), name)


def assign_doc_ids(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "doc_id") -> DataFrame:
    """Sequential document ids from ``start`` in the given (total) order."""
    return with_position(df, order, name, start)

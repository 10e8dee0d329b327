"""Building blocks that keep one hot key, or one global order, from landing in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialize

#: Spark prunes ``row_number() <= k`` before the shuffle up to this k
#: (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANK = 1000
#: Largest total of characters (and rows) a side may have to be shipped to every task.
BROADCAST_CHARS = 64_000_000
BROADCAST_ROWS = 1_000_000
#: Keys with fewer rows than this are not worth spreading, whatever their share.
HOT_ROWS = 100_000


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group under a total order, numbered from 1.

    ``k`` is a number, or a column of the rows that is the same in all rows of a group (k per request);
    a null k gives none.  For a number, each map task keeps at most k rows per group before the shuffle (Catalyst's
    window group limit), so a group holding a large part of the rows still sends only k rows per task.  A column's
    largest value is read first and cuts all groups so; then each keeps its own k.  Beyond the number Catalyst prunes, rows
    are first ranked inside salted parts of the group.
    """
    if not isinstance(k, int):
        most = df.agg(F.max(k)).first()[0] or 0
        return top_k(df, group, order, most, rank).filter(F.col(rank) <= k)
    if k > PRUNED_RANK:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= k).drop("_salt", rank)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def wanted_hits(requests: DataFrame, k: int | None) -> tuple[DataFrame, int]:
    """(request_id, k) of each request, and the largest k: ``k`` for all, or, without it, each request's own ``top_k``."""
    own = F.coalesce(F.max("top_k"), F.lit(0)) if k is None else F.lit(k)
    wanted = requests.groupBy("request_id").agg(own.cast("int").alias("k"))
    return wanted, (wanted.agg(F.max("k")).first()[0] or 0) if k is None else k


def best_of(hits: DataFrame, requests: DataFrame, order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The best hits of each request: ``k`` for all, or, without it, each request's own ``top_k``.

    The hits are cut by the largest number first, where they are; only what is left meets the requests.
    """
    if k is not None:
        return top_k(hits, ["request_id"], order, k, rank)
    wanted, most = wanted_hits(requests, None)
    cut = top_k(hits, ["request_id"], order, most, rank)
    return cut.join(wanted.withColumnRenamed("k", "_k"), "request_id").filter(F.col(rank) <= F.col("_k")).drop("_k")


def greatest(rows: DataFrame, key: Sequence[str], seq: str, value: str) -> DataFrame:
    """(key, seq, value) of each key's row of greatest seq, and of several the greatest value; nulls are least, null keys are equal.

    Where the keys are few enough to be sent to all tasks, the values stay where they are, except those of one key and seq.  The
    rows are read several times.
    """
    names = [*key, seq, value]
    counted = rows.groupBy(*key, seq).agg(F.count(F.lit(1)).alias("_n"))
    first = materialize(counted.groupBy(*key).agg(F.max(F.struct(seq, "_n")).alias("_m")).select(*key, F.col(f"_m.{seq}").alias(seq), "_m._n"), "first")
    if small_enough(first):
        alike = [rows[c].eqNullSafe(F.col(f"_f_{c}")) for c in (*key, seq)]
        rows = rows.join(F.broadcast(first.withColumnsRenamed({c: f"_f_{c}" for c in (*key, seq)})), alike).select(*names, "_n")
        if not first.filter("_n > 1").isEmpty():
            several = rows.filter("_n > 1").groupBy(*key).agg(F.max(F.struct(seq, value)).alias("_m"))
            return rows.filter("_n = 1").select(*names).unionByName(several.select(*key, "_m.*"))
        return rows.select(*names)
    return rows.groupBy(*key).agg(F.max(F.struct(seq, value)).alias("_m")).select(*key, "_m.*")


def group_key(group: Sequence[str]) -> Column:
    """One never-null value that is equal exactly for rows of one group, null being a value like others."""
    return F.to_json(F.struct(*group), {"ignoreNullFields": "false"})


def join_alike(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the columns are those of the left side."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    condition = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in columns]
    return left.join(named, condition, how).drop(*[f"_r_{c}" for c in columns])


def each(df: DataFrame, array: Column, name: str, keep: Sequence[str], pos: str | None = None) -> DataFrame:
    """One row per element of a computed array: the kept columns, [position,] element.  Elements must not be null.

    Same rows as ``explode``.  For a plain explode Catalyst infers a filter on the array's size, which
    repeats the computation of the array, and pushes it down below any shuffle; the outer form does not.
    """
    if pos:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def with_position(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in a total order, without a one-task window.

    The rows are range-partitioned, sorted and written once; the only thing brought together is one
    row count per partition.  ``order`` must end in a unique column.
    """
    run_sorted = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(run_sorted, "positions")
    # The upper bits of _at are the partition number, the lower 33 the row within it.
    run = F.shiftright("_at", 33)
    counts = sorted(stored.groupBy(run.alias("run")).count().collect())
    before = accumulate((r["count"] for r in counts), initial=start)
    offsets = df.sparkSession.createDataFrame(
        [(r["run"], b) for r, b in zip(counts, before)], "_run long, _before long"
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_run", run)
        .join(F.broadcast(offsets), "_run")
        .withColumn(name, F.col("_before") + within)
        .drop("_run", "_at", "_before")
    )


def ordered_runs(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Cut the rows into runs along (group, order); a hot group spans several runs.

    Adds ``_run``.  All rows of a group in run r come before its rows in run r+1, and each
    (group, run) part fits one task.
    """
    keys = [F.col(g) for g in group] + list(order)
    spark = df.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(runs, *keys).withColumn("_run", F.spark_partition_id()), "runs")


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Cumulative sums in order (per group), inclusive of the current row.

    Sums inside each run come from a window over (group, run); what earlier runs add is a window over
    one row per (group, run).
    """
    values = {f"_v_{name}": value for name, value in totals.items()}
    runs = ordered_runs(df.withColumns(values), group, order)
    part = [*group, "_run"]
    sums = runs.groupBy(*part).agg(*[F.sum(v).alias(f"_s{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, *[F.coalesce(F.sum(f"_s{v}").over(earlier), F.lit(0)).alias(f"_o{v}") for v in values])
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_alike(runs, offsets, part).withColumns({n: F.sum(f"_v_{n}").over(local) + F.col(f"_o_v_{n}") for n in totals})
    return joined.select(*df.columns, *totals)


def small_enough(df: DataFrame, text: str | None = None, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether ``df`` (its row count, and the length of its text column) is proven small enough to broadcast."""
    size = F.sum(F.length(text)) if text else F.lit(0)
    n, total = df.agg(F.count(F.lit(1)), size).first()
    return n <= rows and (total or 0) <= chars


def hot_keys(df: DataFrame, key: str, parts: int = 64) -> list:
    """Values of ``key`` holding more than 1/parts of the rows; by that share, fewer than ``parts`` values.

    Counted map-side first; the total is a plain row count, free for a stored table.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.orderBy(F.desc("n")).limit(parts).collect()
    if not largest or largest[0]["n"] < HOT_ROWS:
        return []
    share = df.count() / parts
    return [r[key] for r in largest if r["n"] > share]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int = 64) -> DataFrame:
    """Equi-join on ``key`` that spreads the left rows of hot keys over tasks.

    A key counts as hot from 1/``parts`` of the rows on; its rows are dealt to as many parts as there are
    shuffle partitions (``parts`` at least), so the spread grows with the job.  Only the right rows of the (fewer than ``parts``) hot keys are repeated, so nothing is dropped
    and the repetition is bounded.  Finding the hot keys reads the left key column once more, so the
    left side should be a stored table.  Where there are hot keys it is stored here: a row's place in it is part of its salt, so
    that equal rows are spread too, and must not change when a lost task runs again.  Supports inner, left, left_semi and left_anti joins.
    """
    hot = hot_keys(left, key, parts)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    left = materialize(left, "salted")
    salts = max(parts, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salted_left = left.withColumn("_salt", F.when(is_hot, spread).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(salts))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """Inner equi-join with every right row repeated ``parts`` times and the left rows spread over them.

    For a left side that is costly to compute, much larger than the right one, and likely to have hot keys.
    """
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.withColumn("_salt", spread).join(repeated, [key, "_salt"]).drop("_salt")

"""Score distributions per group: log-softmax, top-k and nucleus filters, reproducible draws.

A distribution is a table (group, item, logit).  A group may hold any share of the rows: sums over a
sorted group are taken over runs (see ``scale.ordered_runs``), never over the group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import md5_int
from corpusflow.operators.scale import group_key, join_alike, ordered_runs, salted_join, top_k


def log_softmax_array(scores: Column) -> Column:
    """Log-softmax of an array of scores, shifted by its largest score."""
    # Inside a lambda every outer expression is evaluated per element; one-element arrays bind the
    # largest score, and then the log of the sum, so that each is computed once.
    top = F.array(F.array_max(scores).cast("double"))
    whole = F.transform(
        top, lambda m: m + F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - m)))
    )
    return F.flatten(F.transform(whole, lambda w: F.transform(scores, lambda x: x.cast("double") - w)))


def probabilities(df: DataFrame, group: Sequence[str], logit: str, item: str) -> DataFrame:
    """Add ``prob`` (softmax within the group), ``log_prob``, and ``cum_prob``: the running sum of prob
    from the highest logit down, ties by item, the current item included."""
    order = [F.desc(logit), F.asc(item)]
    part = [*group, "_run"]
    runs = ordered_runs(df, group, order)
    local = Window.partitionBy(*part)
    runs = runs.withColumn("_top", F.max(F.col(logit).cast("double")).over(local))
    runs = runs.withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    sums = runs.groupBy(*part).agg(F.max("_top").alias("_top"), F.sum("_e").alias("_s"))
    # One row per (group, run): rescale each run's sum to the group's highest logit.
    whole = Window.partitionBy(*group)
    sums = sums.withColumn("_max", F.max("_top").over(whole)).withColumn("_scale", F.exp(F.col("_top") - F.col("_max")))
    scaled = F.col("_s") * F.col("_scale")
    earlier = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *part,
        "_max",
        "_scale",
        F.sum(scaled).over(whole).alias("_z"),
        F.coalesce(F.sum(scaled).over(earlier), F.lit(0.0)).alias("_before"),
    )
    rows = join_alike(runs, sums, part)
    weight = F.col("_e") * F.col("_scale")
    running = F.sum(weight).over(local.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        *df.columns,
        (weight / F.col("_z")).alias("prob"),
        (F.col(logit).cast("double") - F.col("_max") - F.log("_z")).alias("log_prob"),
        ((running + F.col("_before")) / F.col("_z")).alias("cum_prob"),
    )


def top_k_filter(df: DataFrame, group: Sequence[str], logit: str, item: str, k: int) -> DataFrame:
    """Items whose logit is at least the group's k-th highest; ties stay, k=0 keeps all."""
    if k <= 0:
        return df
    best = top_k(df, group, [F.desc(logit), F.asc(item)], k, "_rank")
    least = best.groupBy(group_key(group).alias("_group")).agg(F.min(logit).alias("_least"))
    rows = salted_join(df.withColumn("_group", group_key(group)), least, "_group")
    return rows.filter(F.col(logit) >= F.col("_least")).select(*df.columns)


def nucleus_filter(
    df: DataFrame, group: Sequence[str], logit: str, item: str, p: float, k: int = 0
) -> DataFrame:
    """The head of each distribution up to and including the first item that takes the sum over ``p``.

    ``k`` applies the top-k filter first; the probabilities are those of its survivors.  p=0 keeps all.
    """
    kept = top_k_filter(df, group, logit, item, k)
    if p <= 0:
        return kept
    rows = probabilities(kept, group, logit, item)
    before = F.col("cum_prob") - F.col("prob")
    return rows.filter(before <= p).select(*df.columns, "prob", "cum_prob")


def draw(
    df: DataFrame, group: Sequence[str], logit: str, item: str, seed: int = 0, temperature: float = 1.0
) -> DataFrame:
    """One item per group with softmax probability at a temperature, the same on every run for a seed.

    A group's uniform number comes from md5(group, seed); the first item (highest logit first) whose
    running probability reaches it is drawn.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    scaled = df.withColumn("_logit", F.col(logit).cast("double") / temperature)
    rows = probabilities(scaled, group, "_logit", item)
    name = F.concat_ws("#", *[F.col(g).cast("string") for g in group], F.lit(str(seed)))
    u = md5_int(name, 13) / F.lit(16.0**13)
    # Rounding may leave the last running sum just below u; the last item then stands in.
    reached = F.when(F.col("cum_prob") >= u, F.struct((-F.col("_logit")).alias("o"), F.col(item)))
    last = F.struct((-F.col("_logit")).alias("o"), F.col(item))
    drawn = rows.groupBy(*group).agg(F.coalesce(F.min(reached), F.max(last)).alias("d"))
    return drawn.select(*group, F.col(f"d.{item}").alias(item))

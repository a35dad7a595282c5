"""Operational analytics: percentile rules, rolling frames, failure runs, provider scores, paired arms, classifier metrics, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group over which an exact rank rule is computed at once; larger groups are ranked by value histogram all the same.
RULES = ("nearest", "rounded", "floored", "clamped", "median")


def percentiles(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """All rank rules of a group's p-quantile, exactly: a running count over distinct values stands for the sorted list.

    Equal values are summed before they are shuffled, so a group with a third of all rows costs its distinct values.
    """
    held = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(group).orderBy(value)
    whole = Window.partitionBy(group)
    held = held.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(whole))
    n, at = F.col("total"), lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    mid = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return held.groupBy(group).agg(
        at(F.ceil(n * p) - 1).alias("nearest"), at(F.bround(p * (n - 1))).alias("rounded"), at(F.floor(p * (n - 1))).alias("floored"), at(F.least(n - 1, F.floor(n * p))).alias("clamped"), mid.alias("median")
    )


def latest(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The newest ``most`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def failure_runs(rows: DataFrame, group: str, order: list[str], failed: Column, open_at: int = 5) -> DataFrame:
    """Rows with ``run`` (consecutive failures up to the row) and ``opened`` (the run has reached ``open_at``)."""
    w = Window.partitionBy(group).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    marked = rows.withColumn("_island", island).withColumn("_failed", failed.cast("int"))
    run = F.sum("_failed").over(Window.partitionBy(group, "_island").orderBy(*order))
    return marked.withColumn("run", run).withColumn("opened", F.col("run") >= open_at).drop("_island", "_failed")


def provider_score(success: Column, p95: Column, error: Column, circuit: Column) -> Column:
    """0.40 success, 0.25 latency band, 0.20 lack of errors, 0.15 circuit (100 closed, 50 half-open, 0 open)."""
    band = F.when(p95 <= 200, 100.0).when(p95 <= 500, 80.0).when(p95 <= 2000, 50.0).otherwise(20.0)
    return success * 100 * 0.40 + band * 0.25 + (1 - error) * 100 * 0.20 + circuit * 0.15


def confusion(rows: DataFrame, truth: str, score: str, cut: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn and what follows from them; a ratio without cases is null."""
    yes, said = F.col(truth) == 1, F.col(score) >= cut
    c = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(tn, tn + fp).alias("specificity"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def calibration(rows: DataFrame, truth: str, score: str, bins: int = 5) -> DataFrame:
    """Equal bins of the score with count, mean score and share of positives; empty bins are listed with nulls."""
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    held = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.avg(F.col(truth).cast("double")).alias("positives"))
    return every.join(held, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"), F.round("positives", 6).alias("positives"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key pairs with a mark for each side; pairs with an empty or null part are void."""

    def pairs(x: DataFrame, mark: str) -> DataFrame:
        for k in keys:
            x = x.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
        return x.select(*keys).distinct().withColumn(mark, F.lit(True))

    no = F.lit(False)
    both = pairs(a, "in_a").join(pairs(b, "in_b"), keys, "full_outer")
    return both.withColumn("in_a", F.coalesce("in_a", no)).withColumn("in_b", F.coalesce("in_b", no))


def paired(rows: DataFrame, case: str, arm: str, value: str, one: str, other: str) -> DataFrame:
    """Cases that both arms have, with both values and their difference; of a case's repeats the least counts."""
    side = lambda name, to: rows.where(F.col(arm) == name).groupBy(case).agg(F.min(value).alias(to))
    return side(one, "a").join(side(other, "b"), case).withColumn("delta", F.col("b") - F.col("a"))

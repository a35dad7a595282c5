"""Reports and table maintenance: grouping sets, merge, retention, set algebra, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_report(rows: DataFrame, sets: list[tuple[str, ...]], *aggregates: Column) -> DataFrame:
    """One pass over the rows for all grouping sets; columns outside a set are null, ``grouping`` names the set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    marks = reduce(lambda a, b: F.concat_ws(",", a, b), [F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(marks.alias("grouping"), *aggregates)


def merged(old: DataFrame, new: DataFrame, keys: list[str], newer_wins: bool = True) -> DataFrame:
    """Upsert: rows of both tables, one a key. ``newer_wins`` replaces old rows; otherwise the first stays."""
    first, second = (new, old) if newer_wins else (old, new)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def retained(rows: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return rows.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def size_capped(rows: DataFrame, group: str, size: str, newest: list[Column], most: int) -> DataFrame:
    """The newest rows of each group whose running size stays within ``most``."""
    w = Window.partitionBy(group).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= most).drop("_sum")


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are in both, in a alone and in b alone."""
    both = a.select(key).distinct().withColumn("x", F.lit(1)).join(b.select(key).distinct().withColumn("y", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))

"""Connected components by randomised contraction; every round is a written table, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the component's least node) for every node of the edges (a, b).

    Each round every node moves to the neighbour, or itself, of least hash, and edges follow; nodes fall by
    a constant factor a round in expectation, whatever the graph. Self-loops and repeated edges do no harm;
    nulls are dropped; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    live = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        to = live.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["n"].alias("to"))
        moves.append(materialize(to, "moves"))
        moved = live.join(moves[-1], "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(moves[-1], "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        following = materialize(moved.where("a <> b").distinct(), "edges")
        discard(live)
        live = following
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in reversed(moves[:-1]):
        later = found.withColumnRenamed("node", "to")
        found = step.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root"))
    found = materialize(found, "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    out = materialize(found.join(least, "root").select("node", "component"), "components")
    discard(found, live, *moves)
    return out

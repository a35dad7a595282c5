"""Entities, co-occurrence, degrees, neighbourhoods, connected components and crawl frontiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import written

# What counts as an entity, by kind.
ENTITY_PATTERNS = {
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "url": r"https?://[^\s<>\"']+",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "number": r"[0-9]+(?:\.[0-9]+)?",
    "name": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
}


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, kind, name of every entity mention; a null text has none."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0)).alias("names")) for kind, p in ENTITY_PATTERNS.items()])
    return docs.select("doc_id", F.inline(found)).select("doc_id", "kind", F.explode("names").alias("name"))


def entity_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term (kind:key) of every place in a document, in characters, where the name of one of its entities stands in any case, inside longer words too."""
    def named(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.concat(F.lit(f"{kind}:"), entity_key(n)).alias("term")))

    found = F.flatten(F.array(*[named(kind, p) for kind, p in ENTITY_PATTERNS.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, terms = [], [], []
            for i, text, names in zip(*(c.to_pylist() for c in batch.columns)):
                hits = {(m.start(), x["term"]) for x in names for m in re.finditer(re.escape(x["name"]), text, re.I)}
                ids += [i] * len(hits)
                at += [p for p, _ in hits]
                terms += [t for _, t in hits]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(terms, pa.string())], names=["doc_id", "pos", "term"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array_distinct(found).alias("names")).where(F.size("names") > 0)
    return rows.mapInArrow(run, "doc_id long, pos long, term string")


def weighted(pairs: DataFrame, least: float = 0.1) -> DataFrame:
    """``cooccurrence`` with weight, the share of the greatest count to three places, from ``least`` on."""
    most = pairs.agg(F.max("pairs").alias("most"))
    return pairs.join(F.broadcast(most)).select("term_a", "term_b", "pairs", F.round(F.col("pairs") / F.col("most"), 3).alias("weight")).where(F.col("weight") >= least)


def entities(found: DataFrame) -> DataFrame:
    """Per entity its kind, key, least surface form, mentions and documents."""
    return found.groupBy("kind", entity_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("docs"))


def cooccurrence(text: DataFrame, reach: int = 50) -> DataFrame:
    """term_a, term_b, pairs: how often two different names stand at most ``reach`` words apart.

    ``text`` holds (doc_id, pos, term). Positions fall into bins of ``reach``; a position meets its own bin and the
    next, so the join compares neighbours only.
    """
    bins = text.withColumn("bin", F.floor(F.col("pos") / reach))
    a = bins.withColumn("at", F.explode(F.array(F.col("bin"), F.col("bin") + 1))).alias("a")
    b = bins.alias("b")
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.at") == F.col("b.bin")) & (F.abs(F.col("a.pos") - F.col("b.pos")) <= reach) & (F.col("a.term") != F.col("b.term"))
    once = (F.col("a.at") != F.col("a.bin")) | (F.col("a.term") < F.col("b.term"))
    return a.join(b, near & once).groupBy(F.least("a.term", "b.term").alias("term_a"), F.greatest("a.term", "b.term").alias("term_b")).agg(F.count(F.lit(1)).alias("pairs"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node, degree, share of the greatest degree; vertices without edges have none."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    per = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    if vertices is not None:
        per = vertices.select("node").distinct().join(per, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = per.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    return per.join(F.broadcast(most)).select("node", "degree", F.round(F.col("degree") / F.col("most"), 3).alias("share"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) one undirected step from the seeds."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(seeds.select(F.col("node").alias("a")), "a").select(F.col("a").alias("seed"), F.col("b").alias("node")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: labels sink to the least node. Each round a node takes the least label around it, then its label's label; tables are written every round."""
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        sunk = labels.join(around, "node").select("node", F.least("component", "seen").alias("label"), F.col("component").alias("old"))
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("up"))
        step = written(sunk.join(above, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("component"), "old"), "labels")
        if step.where("component <> old").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")


def frontier(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, level of what is reached from the seeds by at most ``depth`` directed links, at its least level."""
    seen = written(seeds.select("node").distinct().withColumn("level", F.lit(0)), "frontier")
    for level in range(1, depth + 1):
        last = seen.where(F.col("level") == level - 1)
        fresh = links.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = written(fresh.withColumn("level", F.lit(level)), "frontier")
        if fresh.isEmpty():
            break
        seen = written(seen.unionByName(fresh), "frontier")
    return seen

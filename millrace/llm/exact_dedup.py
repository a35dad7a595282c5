"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot is frozen once: its exact buckets and, for each shard of their digests, a static
binary-fuse filter are written as tables, and later batches load them. Incoming digests are
screened by their shard's filter: negatives cannot be in the snapshot, positives join its exact
buckets. Duplicates inside the batch are grouped separately, and both groupings then meet. Rows
whose digests agree are compared byte by byte with the row that stays; a digest with any difference
is grouped anew by its texts. Texts move in that check only. A bucket is aggregated before it is
shuffled, so one with a third of all rows costs a row a task, and its result reaches its rows by a
broadcast of the few buckets that can be so large.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fuse
from millrace.llm.common import attach, bound_batches, discard, materialize, remainder, shared_dir, text_of, write

#: Deleted before texts are compared.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SHARD_KEYS = 200_000
#: Parts of a large group in the byte check.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, in_batch: Column, digest_chars: int = 64) -> DataFrame:
    """doc_id, chars, in_batch, digest (hex SHA-256 of the text without blanks), key (its first 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(t.translate(None, BLANKS)).hexdigest() for t in batch.column(3).to_pylist()]
            keys = pa.array([int(x[:16], 16) - (1 << 64 if x[0] >= "8" else 0) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[:digest_chars] for x in found], pa.string()), pa.array(found, pa.string()), keys], names=["doc_id", "chars", "in_batch", "digest", "sha256", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("chars"), in_batch.alias("in_batch"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, chars long, in_batch boolean, digest string, sha256 string, key long")


def buckets(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays (most code points, then smallest doc_id, null last) and the size."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size"), F.min("key").alias("key"))


def filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter a shard of the snapshot's bucket keys."""

    def run(group: pa.Table) -> pa.Table:
        seed, segment, segments, cells = fuse.build(group["key"].to_numpy())
        return pa.table({"shard": [group["shard"][0].as_py()], "seed": [seed], "segment": [segment], "segments": [segments], "cells": pa.array([cells], pa.binary())})

    return shard(snapshot.select("key"), shards).groupBy("shard").applyInArrow(run, "shard long, seed long, segment long, segments long, cells binary")


def shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")))


def freeze(rows: DataFrame, path: str) -> None:
    """Write the buckets and filters of a snapshot's digests (see ``digests``) to ``path``, which must be new."""
    found = buckets(rows)
    write(found, f"{path}/buckets")
    known = rows.sparkSession.read.schema(found.schema).parquet(f"{path}/buckets")
    shards = max(1, -(-known.count() // SHARD_KEYS))
    write(filters(known, shards).withColumn("shards", F.lit(shards)), f"{path}/filters")


def frozen(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Buckets, filters and number of shards of a snapshot that ``freeze`` wrote."""
    table = spark.read.parquet(f"{path}/filters")
    first = table.select("shards").first()
    return spark.read.parquet(f"{path}/buckets"), table.drop("shards"), first[0] if first else 1


def screen(batch: DataFrame, filter_table: DataFrame, shards: int) -> DataFrame:
    """Digests of the batch's buckets that their shard's filter doesn't rule out."""

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            return ours.select(["digest"]).slice(0, 0)
        f = theirs.to_pylist()[0]
        return ours.select(["digest"]).filter(pa.array(fuse.contains(ours["key"].to_numpy(), f["seed"], f["segment"], f["segments"], f["cells"])))

    incoming = shard(batch.select("digest", "key"), shards)
    return incoming.groupBy("shard").cogroup(filter_table.groupBy("shard")).applyInArrow(run, "digest string")


def merged(snapshot: DataFrame, batch: DataFrame, positives: DataFrame) -> DataFrame:
    """Exact buckets of snapshot and batch: positives join, the other batch digests stay by themselves."""
    known = batch.join(positives, "digest", "left_semi")
    new = batch.join(positives, "digest", "left_anti")
    return buckets_of(snapshot.unionByName(known)).unionByName(new)


def buckets_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("digest").agg(F.min("best").alias("best"), F.sum("size").alias("size"), F.min("key").alias("key"))


def differing(bodies: DataFrame, several: DataFrame) -> DataFrame:
    """The digests of ``several`` under which the bodies are not all the same bytes.

    The least and the greatest body of a digest agree if and only if all do. Salts split a large group.
    """
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = bodies.select("digest", "body", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    held = rows.join(salted, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    return held.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest")


def dedup(docs: DataFrame, in_batch: Column | None = None, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after every ASCII blank is deleted; null counts as empty, so null,
    empty and blank texts form one group. ``in_batch`` tells the incoming rows from the snapshot's
    (unset: half of the ids, by hash). Rows that repeat a doc_id count as copies, and ``kept`` holds for each
    row that bears the staying doc_id; a null doc_id stays only if its group has no other. An empty
    table gives no rows; other columns are ignored. ``digest_chars`` shortens digests in tests.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = materialize(digests(docs, remainder(F.col("doc_id"), 2) == 1 if in_batch is None else in_batch, digest_chars), "digests")
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    freeze(rows.where("not in_batch"), path)
    snapshot, filter_table, shards = frozen(spark, path)
    batch = materialize(buckets(rows.where("in_batch")), "batch")
    positives = screen(batch, filter_table, shards)
    groups = materialize(merged(snapshot, batch, positives).select("digest", F.col("best.d").alias("keep_id"), "size", F.col("size").alias("copies")), "groups")
    discard(batch)

    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).alias("chars"), normalised(text_of()).alias("body"))
    bodies = bodies.withColumn("sha256", F.sha2("body", 256)).withColumn("digest", F.substring("sha256", 1, digest_chars))
    unequal = materialize(differing(bodies, groups.where("size > 1").select("digest")), "unequal")
    if unequal.isEmpty():
        out = attach(rows, groups, ["digest"], "copies")
    else:
        best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")))
        exact = bodies.join(unequal, "digest", "left_semi").groupBy("digest", "body", "sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
        fixed = materialize(exact.select("digest", "sha256", F.col("best.d").alias("keep_id"), "size", F.col("size").alias("copies")), "fixed")
        whole = attach(rows.join(unequal, "digest", "left_anti"), groups.join(unequal, "digest", "left_anti"), ["digest"], "copies")
        parts = attach(rows.join(unequal, "digest", "left_semi"), fixed, ["digest", "sha256"], "copies")
        out = whole.unionByName(parts.select(*whole.columns))
    return out.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; of rows that repeat doc_id and equal texts the longest stays (ties by hash).

    Null, empty and blank texts are equal, as in ``dedup``; an empty table gives no rows. Where no doc_id
    repeats, the staying ids alone select the rows; only rows that share an id (null is one) are told apart by their texts.
    """
    told = materialize(dedup(docs).select("doc_id", "kept", "text_sha256"), "told")
    again = materialize(told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "again")
    stay = told.where("kept").select(F.col("doc_id").alias("stays"), "text_sha256")
    if again.isEmpty():
        return docs.join(stay.select("stays"), F.col("doc_id").cast("long").eqNullSafe(F.col("stays")), "left_semi")
    repeats = F.col("doc_id").cast("long").eqNullSafe(F.col("again"))
    alone = stay.join(again, F.col("stays").eqNullSafe(F.col("again")), "left_anti")
    single = docs.join(alone, F.col("doc_id").cast("long").eqNullSafe(F.col("stays")), "left_semi")
    several = docs.join(again, repeats, "left_semi").select(F.col("doc_id").cast("long").alias("_id"), F.sha2(normalised(text_of()), 256).alias("_sha"), F.struct(F.length(text_of()).alias("n"), F.hash(text_of()).alias("h"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")).alias("_row"))
    best = several.groupBy("_id", "_sha").agg(F.max_by("_row", F.struct(F.col("_row.n"), F.col("_row.h"))).alias("_row"))
    held = best.join(stay.distinct(), F.col("_id").eqNullSafe(F.col("stays")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return single.unionByName(held.select("_row.row.*"))


ORACLE = """
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
      FROM documents)
"""

"""Shared plumbing of the training-data operators: tables, shared storage, row identity."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import shared_dir

#: ASCII white space as the contracts write it.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends at the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def write(df: DataFrame, path: str) -> None:
    """Write a table in files of the advisory size: a small one takes few tasks, not one for every core."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)


#: Rows and bytes of an Arrow batch that texts are handed to Python in.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """From now on at most ``BATCH`` rows and bytes go to Python at once, however long the texts; lower settings stay."""
    for name, most in BATCH.items():
        now = int(re.sub(r"\D", "", spark.conf.get(name) or "") or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key's text modulo ``of``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def attach(rows: DataFrame, side: DataFrame, keys: list[str], count: str, parts: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row for every key of theirs; ``count``, dropped, tells how many have it.

    Keys with more than one row in ``parts`` are hot. At most ``parts`` keys can be, whatever the table's size, so
    theirs are broadcast; the others are shuffled, and no task gets more than one row in ``parts`` for a key.
    Rows with a null key are not shuffled and match nothing. Both inputs are read several times, so they
    should be written tables or cheap to compute.
    """
    limit = max(1, rows.count() // parts)
    hot, cold = side.where(F.col(count) > limit).drop(count), side.where(F.col(count) <= limit).drop(count)
    whole = " and ".join(f"`{k}` is not null" for k in keys)
    known = rows.where(whole)
    done = known.join(F.broadcast(hot), keys)
    rest = known.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    unkeyed = rows.where(f"not ({whole})").select("*", *[F.lit(None).cast(t).alias(c) for c, t in hot.dtypes if c not in keys])
    return done.unionByName(rest).unionByName(unkeyed)

"""Consistent weighted sampling fingerprints, in DataFrame operations only.

A text's terms are its words, a term's weight how often it occurs. For every sample k a term draws
r and c from Gamma(2, 1) and b from the unit interval, all from a hash of (term, k); with weight w
it is sampled at level t = floor(ln w / r + b) and its value is c / exp(r (t - b + 1)). The term of
least value is the sample. Two texts agree in a sample with a probability equal to their
generalised Jaccard similarity, sum of least weights over sum of greatest. The least value itself
stands for (term, t), so a sample is one double and taking it is a plain ``min``. A Gamma(2, 1) is
minus the logarithm of a product of two uniforms.

The next document in falling doc_id is found in id ranges: every range gets, as one extra row, the
first document of the range below, so no range looks outside itself.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_of

SAMPLES = 48
RANGES_PER_PARTITION = 4


def words_of(text: Column) -> Column:
    """Hashes of the text's words, sorted."""
    return F.sort_array(F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)))


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """The term's value in sample k. The 64 bits of one hash give the four uniforms of both gammas and b."""
    x = F.xxhash64(term, F.lit(k))
    uniform = lambda shift: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(8191)).cast("double") + 0.5
    scale = F.lit(2.0**-26)
    r, c = -F.log(uniform(0) * uniform(13) * scale), -F.log(uniform(26) * uniform(39) * scale)
    b = (F.shiftrightunsigned(x, 52).cast("double") + 0.5) * F.lit(2.0**-12)
    return c * F.exp(-r * (F.floor(log_weight / r + b).cast("double") - b + 1.0))


def terms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row per distinct word of the text: ``keep``, term, weight; one row with nulls for a text without words."""
    sorted_ = df.select(*keep, words_of(F.col(text)).alias("_words"))
    n = F.size("_words")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    starts = sorted_.withColumn("_starts", F.when(n > 0, heads).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_starts", lambda p, j: F.struct(F.get("_words", p).alias("term"), (F.coalesce(F.get("_starts", j + 1), n) - p).alias("weight")))
    return starts.select(*keep, F.inline_outer(runs))


def samples(rows: DataFrame, keys: list[str], also: list[str], k: int = SAMPLES) -> DataFrame:
    """Per key the columns ``also`` (longs, alike in all rows of a key) and ``sig``: the samples, null for a text without words."""
    logged = rows.withColumn("log_weight", F.log(F.col("weight").cast("double")))
    per = logged.groupBy(*keys).agg(*[F.min(c).alias(c) for c in also], *[F.min(sample_value(F.col("term"), F.col("log_weight"), i)).alias(f"_{i}") for i in range(k)])
    return per.select(*keys, *also, F.when(F.col("_0").isNotNull(), F.array(*[f"_{i}" for i in range(k)])).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree; texts without words are alike, and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a).cast("double"))


def written(sig: Column) -> Column:
    """Eight hex digits a sample; the empty string without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0")), ""), F.lit(""))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key (a null key is in the lowest range), by a two-level search."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    array = lambda x: F.lit(np.array(x, dtype=np.int64))
    below = lambda column: F.size(F.filter(column, lambda b: b < key))
    coarse = below(array(bounds[step - 1 :: step])) if len(bounds) >= step else F.lit(0)
    return F.when(key.isNull(), 0).otherwise(coarse * step + below(F.slice(array(bounds), coarse * step + 1, step)))


def ranged(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, ghost: documents dealt into id ranges of about equal size, and each range's extra row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    rows = rows.withColumn("part", range_of(F.col("doc_id"), sorted(set(found))))
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head"))
    below = Window.orderBy("part")
    whole = below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most n rows: one a range
    links = heads.select(F.coalesce(F.lag("part").over(below), F.last("part").over(whole)).alias("from"), F.col("part").alias("part"))
    links = F.broadcast(links.join(heads.select(F.col("part").alias("from"), "head"), "from").select(F.col("part").alias("to"), "from", "head"))
    first = rows.join(links, (F.col("part") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy(F.col("to").alias("part")).agg(F.max(F.struct("doc_id", "text")).alias("d"))
    ghosts = first.select("d.doc_id", "d.text", "part", F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def _halves(sha: str) -> list[Column]:
    return [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"_sha{i}") for i in range(4)]


def fingerprints(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many of the next
    document's first (or all it has); documents follow each other in falling doc_id, null ids last, repeated ids
    by falling text, and the first follows the last (a lone document itself). Null texts count as
    empty. Texts without words have the empty fingerprint, alike to one another and to no other. An empty
    table gives no rows; other columns are ignored.
    """
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = ranged(docs).withColumn("rank", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    pairs = placed.select("part", "rank", "doc_id", F.col("ghost").cast("long").alias("ghost"), n.cast("long").alias("n_chars"), "text", F.when(~F.col("ghost"), edited).alias("edited"))
    pairs = pairs.withColumn("_sha", F.sha2("edited", 256))
    both = pairs.select("part", "rank", "doc_id", "ghost", "n_chars", *_halves("_sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.coalesce("edited", F.lit("")).alias("body")))).alias("x"))
    both = both.select("part", "rank", F.col("x.which").alias("which"), "doc_id", "ghost", "n_chars", *[f"_sha{i}" for i in range(4)], F.col("x.body").alias("body"))
    also = ["doc_id", "ghost", "n_chars", *[f"_sha{i}" for i in range(4)]]
    signed = samples(terms(both, "body", "part", "rank", "which", *also), ["part", "rank", "which"], also, k)
    own = lambda w: F.max(F.when(F.col("which") == w, F.col("sig")))
    joined = signed.groupBy("part", "rank").agg(*[F.min(c).alias(c) for c in also], own(0).alias("sig"), own(1).alias("edited_sig"))
    joined = joined.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("part").orderBy("rank"))).where("ghost = 0")
    sha = reduce(lambda a, b: F.concat(a, b), [F.lpad(F.lower(F.hex(f"_sha{i}")), 16, "0") for i in range(4)])
    return joined.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), written(F.col("sig")).alias("fingerprint"), written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )

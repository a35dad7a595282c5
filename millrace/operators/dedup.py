"""Deduplication: exact, by signature, by URL, after cleaning, and by 64-bit SimHash with a band join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TOKENS = r"[a-z0-9一-鿿]+"
BANDS, BAND_BITS = 4, 16


def first_by(df: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of every key in the given order.

    Keys with a third of all rows are reduced before the shuffle: ``min_by`` keeps one candidate a task.
    """
    named = {f"_k{i}": k if isinstance(k, Column) else F.col(k) for i, k in enumerate(keys)}
    best = df.select(*[c.alias(n) for n, c in named.items()], F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_r"))
    return best.groupBy(*named).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def drop_copies(df: DataFrame, content: str, key: str) -> DataFrame:
    """Of rows with the same content the one of least key; null counts as empty."""
    return first_by(df, [F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary"))], key)


def signature(text: Column, chars: int = 200) -> Column:
    """The first ``chars`` characters, lower-case, without blanks at the ends: a signature, not the text."""
    return F.trim(F.lower(F.substring(text, 1, chars)))


def tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(0)), lambda t: F.length(t) >= least)


#: Words whose bits are added up at once, or those of one longer text.
WORDS_AT_ONCE = 20_000


@F.arrow_udf(LongType())
def simhash(words: pa.Array) -> pa.Array:
    """64-bit SimHash of token lists: bit i is set if more token hashes have it than not. No tokens give 0.

    A few lists are looked at at a time, and their words stay in Arrow but for one copy of each.
    """
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat, out, at = words.flatten(), np.zeros(len(words), np.int64), 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1)
        some = flat.slice(ends[at], ends[to] - ends[at]).dictionary_encode()
        digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in some.dictionary.to_pylist()), np.uint8).reshape(-1, 8)
        bits = np.unpackbits(digests, axis=1).astype(np.int8) * 2 - 1
        held = at + np.flatnonzero(np.diff(ends[at : to + 1]))
        if len(held):
            on = np.add.reduceat(bits[some.indices.to_numpy()], ends[held] - ends[at], axis=0, dtype=np.int32) > 0
            out[held] = np.packbits(on, axis=1).view(">i8")[:, 0]
        at = to
    return pa.array(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(fp: Column) -> Column:
    """Each band's number and bits: fingerprints within BANDS - 1 bits of each other share one at least."""
    return F.array(*[F.shiftrightunsigned(fp, BAND_BITS * i).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).bitwiseOR(F.lit(i << BAND_BITS)) for i in range(BANDS)])


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """Per fingerprint its least doc_id and how many documents bear it, so copies never meet pairwise."""
    return fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def near_pairs(classes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of fingerprint classes at most ``most`` (up to BANDS - 1) bits apart."""
    if most >= BANDS:
        raise ValueError(f"bands find distances up to {BANDS - 1}")
    keyed = classes.withColumn("band", F.explode(band_keys(F.col("fp"))))
    a, b = keyed.alias("a"), keyed.alias("b")
    close = (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (hamming(F.col("a.fp"), F.col("b.fp")) <= most)
    return a.join(b, close).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), hamming(F.col("a.fp"), F.col("b.fp")).alias("distance")).distinct()


def nearest(probes: DataFrame, classes: DataFrame, bits: int = 64) -> DataFrame:
    """Per probe (id, fp) the nearest class that shares a band with it: doc_id and distance; ``bits`` where none does."""
    a = probes.withColumn("band", F.explode(band_keys(F.col("fp")))).alias("a")
    b = classes.withColumn("band", F.explode(band_keys(F.col("fp")))).alias("b")
    found = a.join(b, F.col("a.band") == F.col("b.band")).groupBy("a.id").agg(F.min(F.struct(hamming(F.col("a.fp"), F.col("b.fp")).alias("distance"), F.col("b.doc_id"))).alias("best"))
    return probes.select("id").join(found, "id", "left").select("id", "best.doc_id", F.coalesce("best.distance", F.lit(bits)).alias("distance"))

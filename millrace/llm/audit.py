"""Which filters remove what, in every order: an audit by Walsh-Hadamard sums.

Every document fails a set of the five filters, a mask of five bits. For each part and label, 32 signed
sums are aggregated: that of subset S adds 1 for a document that fails an even number of S's
filters and takes 1 away otherwise. The transform is its own inverse up to a factor of 32, so the sums give
the exact number of documents of each mask, and from these cells any order of the filters follows
without another look at the documents. Over all 120 orders a filter removes a document that fails k filters
120 / k times, whatever the others, which gives the Shapley column.

A text's smallest doc_id is found with partial minima, and only the rows that bear it are looked up
(by digest and doc_id, so copies by the thousand meet in no task): all rows are summed as copies, and
the rows of smallest id are taken back and summed again without that failure.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, text_of

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
BLANK = r"[\x20\x09-\x0D]+"
LABELS = ("every", "good", "toxic")


def failures(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep``, the text's digest and ``fails``: the bits of A to D that a text fails."""
    words = F.array_remove(F.split("text", BLANK), "")
    read = docs.select(*keep, text_of().alias("text")).select("*", words.alias("words"))
    read = read.select("*", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    bits = [F.col("n") < 200, 100 * F.col("distinct") < 50 * F.col("n"), 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return read.withColumn("digest", F.sha2("text", 256)).withColumn("fails", mask).drop("words", "n", "distinct", "text")


def sign(a: Column, b: Column) -> Column:
    """1 if the masks share an even number of bits, else -1."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(1)


def parity_sums(rows: DataFrame) -> DataFrame:
    """Per part and label the 32 signed sums, from rows of part, mask, n (how many documents), good and toxic."""
    n = {"every": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = [F.sum(n[x] * sign(F.col("mask"), F.lit(s))).alias(f"{x}{s}") for x in LABELS for s in range(CELLS)]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{x}{s}") for s in range(CELLS)]).alias(x) for x in LABELS])


def cells(sums: Column) -> Column:
    """The number of documents of each mask, from the signed sums: their transform, divided by 32."""
    masks = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.transform(masks, lambda m: (F.aggregate(masks, F.lit(0).cast("long"), lambda at, s: at + F.element_at(sums, s + 1) * sign(m, s)) / CELLS).cast("long"))


def counted(rows: DataFrame) -> DataFrame:
    """Rows by part, digest, fails and labels with their number ``n``, told apart by doc_id, as parity rows: part, mask, n, good, toxic."""
    rows = materialize(rows, "failures")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    first = rows.join(least, ["digest", "doc_id"]).unionByName(rows.where("doc_id is null"))
    row = lambda df, mask, n: df.select("part", mask.alias("mask"), n.alias("n"), "good", "toxic")
    failing = F.col("fails").bitwiseOR(COPY)
    return row(rows, failing, F.col("n")).unionByName(row(first, failing, -F.col("n"))).unionByName(row(first, F.col("fails"), F.col("n")))


def orders() -> Column:
    """Every order of the filters and every step of it: filter_order, step, bit (of its filter), before (bits of those that came earlier)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [{"filter_order": "".join(o), "step": i + 1, "bit": bit[o[i]], "before": sum(bit[f] for f in o[:i])} for o in permutations(FILTERS) for i in range(len(o))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def evaluate(by_part: DataFrame) -> DataFrame:
    """One row per part (with its cells by label), order and step."""
    steps = by_part.select("*", F.explode(orders()).alias("o")).select("part", *LABELS, "o.*")
    bit, before = F.col("bit"), F.col("before")
    masks = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def total(label: str, holds, times=None) -> Column:
        count = lambda m: F.element_at(F.col(label), m + 1) * (times(m) if times else 1)
        return F.aggregate(masks, F.lit(0).cast("long"), lambda at, m: at + F.when(holds(m), count(m)).otherwise(0))

    meets = lambda m, of: m.bitwiseAND(of) != 0
    here = lambda m: meets(m, bit) & ~meets(m, before)
    return steps.select(
        "part", "filter_order", "step",
        total("every", lambda m: ~meets(m, bit) & ~meets(m, before)).alias("kept"),
        total("every", here).alias("removed"),
        total("every", lambda m: meets(m, bit) & meets(m, before)).alias("redundant"),
        F.element_at("every", bit + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("every", lambda m: meets(m, bit), lambda m: (120 / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang, null as empty), filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty and equal to other empty ones. A null doc_id is smaller than no other and no other is
    smaller than it, so it never fails E and has no label; rows that repeat a doc_id are documents of their own,
    none smaller than the other. A doc_id labelled more than once is good (toxic) if any of its labels
    says so. Very long texts are read whole, one row at a time. Without documents there are no parts and
    no rows; other columns are ignored.
    """
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key"))
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    read = failures(docs, F.col("doc_id"), part).groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id get keys of their own, so that they do not meet in one task
    keyed = read.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), "digest")))
    told = keyed.join(known, "key", "left").drop("key").fillna({"good": False, "toxic": False})
    sums = parity_sums(counted(told))
    return evaluate(sums.select("part", *[cells(F.col(x)).alias(x) for x in LABELS]))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit,
    before <> '' AND len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AS gone
  FROM c, s
),
r AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

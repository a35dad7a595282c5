"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source gets a target of words by water filling. Its weight over training time t in [0, 1] is
``target * (1 + a * (1 - 2 t))``; the integral up to t is ``target * (t + a * (t - t * t))``. A
document whose copy starts after q of its source's taken words stands where that integral
reaches q: the schedule is inverted, and documents are range-sorted by position. The
cumulative demand is a two-level prefix sum (hash ranges of a source, then rows of a range), so a
source with a third of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import NOT_SPACE, materialize, text_of

#: Weights and curriculum slopes of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SLOPES = (0.8, 0.0, -0.8)
SHARE = 1.5
MOST = 2


#: Sources whose totals are broadcast; more of them are joined by shuffle.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size (words of the text), key (the order in the source), and a struct ``row`` of ``keep`` if given."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(NOT_SPACE)).cast("long").alias("size"), key.alias("key"), *([F.struct(*keep).alias("row")] if keep else []))


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: source_size, rows, slope and target, by filling up to MOST times its size.

    Sources that the level reaches are those of least size per weight; with them at their most, the
    rest share what is left by weight.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("full_at", "rank")
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    per = per.withColumn("rank", F.row_number().over(every)).withColumn("weight", cycle(WEIGHTS, F.col("rank")).cast("double")).withColumn("slope", cycle(SLOPES, F.col("rank")))
    per = per.withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("full_at", F.col("most") / F.col("weight"))
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("left", left).withColumn("weights", weights).withColumn("full", F.col("full_at") * F.col("weights") < F.col("left"))
    level = F.min(F.when(~F.col("full"), F.struct("full_at", "rank", "left", "weights"))).over(whole)
    per = per.withColumn("level", level)
    shared = F.col("level.left") * F.col("weight") / F.col("level.weights")
    return per.select("source", "source_size", "rows", "slope", F.when(F.col("full"), F.col("most")).otherwise(shared).alias("target"))


def invert(q: Column, a: Column) -> Column:
    """The t in [0, 1] with t + a (t - t^2) = q."""
    b = 1.0 + a
    return 2.0 * q / (b + F.sqrt(F.greatest(b * b - 4.0 * a * q, F.lit(0.0))))


def placed(docs: DataFrame, *keep: str) -> DataFrame:
    """Every row with its source's totals, the words taken of it, and both copies' positions; ``keep`` are carried in ``row``."""
    rows = materialize(sizes(docs), "sizes")
    per = materialize(targets(rows).withColumn("parts", F.ceil(F.sqrt(F.col("rows").cast("double")))).withColumnRenamed("source", "of"), "targets")
    small = per.count() <= BROADCAST_SOURCES
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("parts")).cast("long")

    def enrich(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("part", part)

    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = enrich(rows).groupBy("source", "part").agg(F.sum("size").alias("words")).select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = enrich(sizes(docs, *keep) if keep else rows).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    first = F.col("ahead") + F.col("within")
    demand = F.floor("target")
    took = lambda start: F.greatest(F.lit(0), F.least(demand - start, F.col("size")))
    out = out.withColumn("first", first).withColumn("second", F.col("source_size") + first)
    out = out.withColumn("taken_1", took(F.col("first"))).withColumn("taken_2", took(F.col("second")))
    at = lambda start, taken: F.when(taken > 0, F.round(invert(start / F.col("target"), F.col("slope")), 9))
    return out.withColumn("position", at(F.col("first"), F.col("taken_1"))).withColumn("repeat_position", at(F.col("second"), F.col("taken_2")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, position, repeat_position.

    A source takes the first floor(target) words of its documents in hash order, then of their second
    copies. ``position`` is where the first copy starts, ``repeat_position`` the second (null when not
    taken); rows come in order of position. Null texts have no words; null sources form one source, last
    in order; repeated doc_ids tie by size and are taken as rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    out = placed(docs).select("doc_id", "size", "source_size", "target", (F.col("taken_1") + F.col("taken_2")).alias("taken"), "position", "repeat_position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy taken, in training order.

    A copy taken in part keeps its first words, joined by single blanks, and its own n_chars where there
    is that column. Documents without words are taken by no source and stay out.
    """
    names = docs.columns
    taken = placed(docs, *names)
    copies = F.array(F.struct(F.col("position").alias("p"), F.col("taken_1").alias("n")), F.struct(F.col("repeat_position").alias("p"), F.col("taken_2").alias("n")))
    rows = taken.select("row", "size", F.inline(F.filter(copies, lambda c: c["n"] > 0)))
    rows = rows.repartitionByRange(F.col("p"), F.col("row.doc_id")).sortWithinPartitions("p", "row.doc_id")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(NOT_SPACE), F.lit(0)), F.lit(1), F.col("n").cast("int")), " ")
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(cut)
    out = rows.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*[(new.get(c) if new.get(c) is not None else F.col("row")[c]).alias(c) for c in names])


ORACLE = """
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM rows GROUP BY source),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[(rank - 1) % 3 + 1]::DOUBLE AS weight,
         ([0.8, 0.0, -0.8])[(rank - 1) % 3 + 1]::DOUBLE AS a,
         (2 * source_size)::DOUBLE AS most
  FROM per),
filled AS (
  SELECT *, most / weight AS full_at,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER f, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weights
  FROM weighed
  WINDOW f AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT left_over, weights FROM filled WHERE NOT full_at * weights < left_over ORDER BY full_at, rank LIMIT 1),
target AS (
  SELECT f.source, f.source_size, f.a,
         CASE WHEN f.full_at * f.weights < f.left_over THEN f.most ELSE l.left_over * f.weight / l.weights END AS target
  FROM filled f, level l),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.a, floor(t.target)::BIGINT AS demand,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM rows r JOIN target t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(demand - first, size)) AS taken_1,
         greatest(0, least(demand - source_size - first, size)) AS taken_2,
         first / target AS q1, (source_size + first) / target AS q2
  FROM placed)
SELECT doc_id, size, source_size, target, taken_1 + taken_2 AS taken,
       CASE WHEN taken_1 > 0 THEN
         round(2.0::DOUBLE * q1 / ((1.0 + a) + sqrt(greatest((1.0 + a) * (1.0 + a) - 4.0 * a * q1, 0.0))), 9) END AS position,
       CASE WHEN taken_2 > 0 THEN
         round(2.0::DOUBLE * q2 / ((1.0 + a) + sqrt(greatest((1.0 + a) * (1.0 + a) - 4.0 * a * q2, 0.0))), 9) END AS repeat_position
FROM taken
"""

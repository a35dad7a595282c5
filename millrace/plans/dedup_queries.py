"""Deduplication queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import web as U
from millrace.operators import dedup as D
from millrace.plans.registry import query, table
from millrace.plans.web_queries import RESULT_KEY

_FP = r"""
WITH sources AS ({rows}),
tok AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{4e00}}-\x{{9fff}}]+'), lambda x: length(x) >= 2)) AS t FROM sources),
cnt AS (SELECT id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h, count(*) AS n FROM tok GROUP BY ALL),
bits AS (SELECT id, i, sum(n * (2 * ((h >> i) & 1)::INTEGER - 1)) > 0 AS bit FROM cnt, range(64) r(i) GROUP BY id, i),
fps AS (SELECT s.id, coalesce(f, 0)::UBIGINT AS fp FROM sources s LEFT JOIN (SELECT id, sum(CASE WHEN bit THEN 1::HUGEINT << i ELSE 0 END) AS f FROM bits GROUP BY id) USING (id)),
classes AS (SELECT fp, min(id) AS id, count(*) AS copies FROM fps GROUP BY fp)
"""


def _sql(rows: str, tail: str) -> str:
    return _FP.format(rows=rows) + tail


@query("exact_dup", "SELECT md5(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("drop_copies", "SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1")
def drop_copies(spark, sf_dir):
    return D.drop_copies(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang", "n_chars")


@query("signature_dedup", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY trim(lower(substr(coalesce(text, ''), 1, 200))) ORDER BY n_chars DESC, doc_id) = 1")
def signature_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", D.signature(F.coalesce("text", F.lit(""))).alias("s"))
    return D.first_by(docs, ["s"], -F.col("n_chars"), F.col("doc_id")).select("doc_id", "lang")


@query("required_dedup", r"""
WITH cleaned AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL AND text <> '' AND source <> '')
SELECT doc_id, source, length(t) AS chars FROM cleaned WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY t, source ORDER BY doc_id) = 1
""")
def required_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null and text <> '' and source <> ''")
    cleaned = docs.select("doc_id", "source", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("t")).where("t <> ''")
    keyed = cleaned.select("doc_id", "source", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))
    return D.first_by(keyed, ["digest", "source"], F.col("doc_id")).select("doc_id", "source", "chars")


@query("url_dedup", f"SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS position FROM (SELECT page_id, url, {RESULT_KEY} AS key FROM pages QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1)")
def url_dedup(spark, sf_dir):
    """The first page of every result key; the kept ones are numbered anew."""
    kept = D.first_by(table(spark, sf_dir, "pages").select("page_id", "url"), [U.result_key(F.col("url"))], F.col("page_id"))
    return _numbered(kept)


def _numbered(rows, width: int = 4096):
    """``position``: the rank by page_id. Ranks are counted by id range, and only ranges are summed in one task."""
    rows = rows.withColumn("part", F.floor(F.col("page_id") / width))
    counts = rows.groupBy("part").count().withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("page_id"))).join(counts, "part")
    return ranked.select("page_id", "url", (F.col("ahead") + F.col("n")).alias("position"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.simhash(D.tokens(F.col("text"))).alias("fp"))


@query("simhash_fp", _sql("SELECT doc_id AS id, text FROM documents", "SELECT id AS doc_id, lpad(lower(hex(fp)), 16, '0') AS fp FROM fps"))
def simhash_fp(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"))


@query("near_dup_pairs", _sql("SELECT doc_id AS id, text FROM documents", "SELECT a.id AS doc_a, b.id AS doc_b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM classes a JOIN classes b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 3"))
def near_dup_pairs(spark, sf_dir):
    return D.near_pairs(D.fingerprint_classes(_documents(spark, sf_dir)))


@query("near_dup_members", _sql("SELECT doc_id AS id, text FROM documents", "SELECT id AS doc_id, min(id) OVER (PARTITION BY fp) AS class_id, count(*) OVER (PARTITION BY fp) AS copies FROM fps"))
def near_dup_members(spark, sf_dir):
    """The fingerprint class of every document, whose representatives ``near_dup_pairs`` links, and its size."""
    docs = _documents(spark, sf_dir)
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return docs.join(classes, "fp").select("doc_id", "class_id", "copies")


@query("contamination", _sql("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark", """,
docs AS (SELECT fp, min(id) AS id FROM fps WHERE id >= 0 GROUP BY fp),
probes AS (SELECT -1 - id AS item_id, fp FROM fps WHERE id < 0),
hits AS (
  SELECT p.item_id, min({'distance': bit_count(xor(p.fp, d.fp))::INTEGER, 'doc_id': d.id}) AS best
  FROM probes p JOIN docs d ON ((p.fp >> 0) & 65535) = ((d.fp >> 0) & 65535) OR ((p.fp >> 16) & 65535) = ((d.fp >> 16) & 65535)
    OR ((p.fp >> 32) & 65535) = ((d.fp >> 32) & 65535) OR ((p.fp >> 48) & 65535) = ((d.fp >> 48) & 65535) GROUP BY p.item_id)
SELECT p.item_id AS id, h.best.doc_id AS doc_id, coalesce(h.best.distance, 64) AS distance FROM probes p LEFT JOIN hits h USING (item_id)
"""))
def contamination(spark, sf_dir):
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), D.simhash(D.tokens(F.col("text"))).alias("fp"))
    return D.nearest(probes, D.fingerprint_classes(_documents(spark, sf_dir)))

"""Retrieval queries: the benchmark items ask, documents and vectors answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.plans.registry import query, table

_W = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9\x{{4e00}}-\x{{9fff}}]+')"


@query("bm25_topk", rf"""
WITH toks AS (SELECT doc_id, {_W.format("text")} AS w FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM toks),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_W.format("text")}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, term, count(*) AS tf, min(n) AS length FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, stats GROUP BY term, docs),
scored AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM asked JOIN post USING (term) JOIN idf USING (term), stats GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10
""")
def bm25_topk(spark, sf_dir):
    """Every word of an item asks."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(R.words(F.col("text"))).alias("term"))
    return R.bm25(table(spark, sf_dir, "documents"), queries, 10)


@query("term_idf", rf"""
WITH toks AS (SELECT doc_id, list_distinct({_W.format("text")}) AS w FROM documents), n AS (SELECT count(*) AS docs FROM toks)
SELECT term, count(*) AS df, round(ln(1 + (docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM (SELECT unnest(w) AS term FROM toks), n GROUP BY term, docs
""")
def term_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(R.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("vector_topk", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v, v q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10 AND similarity >= 0.5
""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return R.cosine(rows, rows.where("vec_id % 100 = 0"), 10, 0.5)


_LISTS = """
WITH a AS (SELECT lang AS "group", doc_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT lang AS "group", doc_id, length(source)::DOUBLE AS score, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank FROM documents)
"""


def _lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "group")
    a = docs.select("group", "doc_id", F.col("n_chars").cast("double").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.col("score").desc(), "doc_id"))).where("rank <= 50")
    b = docs.select("group", "doc_id", F.length("source").cast("double").alias("score"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("k"))
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy("k", "doc_id"))).where("rank <= 50").drop("k")
    return a, b


@query("rrf_fusion", _LISTS + """SELECT "group", doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT "group", doc_id, rank FROM a WHERE rank <= 50 UNION ALL SELECT "group", doc_id, rank FROM b WHERE rank <= 50) GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    return R.reciprocal_fusion(a.drop("score").unionByName(b.drop("score"))).withColumn("score", F.round("score", 8))


@query("weighted_fusion", _LISTS + """
, x AS (SELECT "group", doc_id, 0.5::DOUBLE * score / max(score) OVER (PARTITION BY "group") AS part FROM a WHERE rank <= 50
        UNION ALL SELECT "group", doc_id, 0.5::DOUBLE * score / max(score) OVER (PARTITION BY "group") FROM b WHERE rank <= 50)
SELECT "group", doc_id, round(sum(part), 8) AS score FROM x GROUP BY ALL
""")
def weighted_fusion(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    return R.weighted_fusion(a.drop("rank"), b.drop("rank")).withColumn("score", F.round("score", 8))


@query("fixed_chunks", r"""
SELECT doc_id, start, md5(part) AS part FROM (SELECT doc_id, s::INTEGER AS start, substr(t, s + 1, 500) AS part FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 450)) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
WHERE regexp_replace(part, '\s', '', 'g') <> ''
""")
def fixed_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.chunks(F.coalesce("text", F.lit("")))).alias("c"))
    return c.select("doc_id", "c.start", F.md5(F.col("c.part").cast("binary")).alias("part"))


@query("keyword_density", r"""
WITH toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+'), lambda x: length(x) > 2) AS w FROM documents),
n AS (SELECT doc_id, len(w) AS total, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM toks),
c AS (SELECT doc_id, total, term, count(*) AS times, min(pos) AS first FROM n GROUP BY ALL)
SELECT doc_id, term, times, round(100.0::DOUBLE * times / total, 2) AS density FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first) <= 20
""")
def keyword_density(spark, sf_dir):
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda x: F.length(x) > 2)
    c = R.keyword_density(table(spark, sf_dir, "documents").select("doc_id", w.alias("w")), "w")
    return c.select("doc_id", "term", "times", F.round(100.0 * F.col("times") / F.col("total"), 2).alias("density"))


@query("rerank_terms", rf"""
WITH x AS (SELECT b.item_id, list_distinct({_W.format("b.text")}) AS q FROM benchmark b),
p AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
pt AS (SELECT page_id, url, title, list_distinct({_W.format("title")}) AS tt, list_distinct({_W.format("url")}) AS ut FROM p),
m AS (SELECT DISTINCT item_id, page_id FROM (SELECT item_id, unnest(q) AS t FROM x) JOIN (SELECT page_id, unnest(list_distinct(list_concat(tt, ut))) AS t FROM pt) USING (t)),
s AS (SELECT item_id, page_id, 3.0 * len(list_intersect(q, tt)) + 1.5 * len(list_intersect(q, tt)) + len(list_intersect(q, ut))
        + CASE WHEN len(list_filter(q, lambda w: NOT list_contains(tt, w) AND NOT list_contains(ut, w))) = 0 AND len(q) > 0 THEN 5 ELSE 0 END - CASE WHEN length(title) < 20 THEN 2 ELSE 0 END AS score
      FROM m JOIN x USING (item_id) JOIN pt USING (page_id))
SELECT item_id, page_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS rank FROM s QUALIFY rank <= 10
""")
def rerank_terms(spark, sf_dir):
    """Every word of an item asks, over pages that share a term by their title or their URL; the title stands for the snippet."""
    return R.rerank_pages(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q")), table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title")), 10)

"""Queries of the text functions over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query, table

_GRADED = r"""
WITH body AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM documents),
shape AS (
  SELECT doc_id, lang, b, length(b) AS n,
         list_filter([trim(x, E' \t\n\r') FOR x IN regexp_split_to_array(b, '[.!?\x{3002}\x{ff01}\x{ff1f}\n]+')], lambda x: x <> '') AS parts,
         length(regexp_replace(b, '[^\p{L}\p{N}\p{P}\p{S}\s]', '', 'g')) / nullif(length(b), 0) AS readable,
         len(regexp_extract_all(b, '(?i)<(html|head|body|script|style|title|meta|link|noscript)\b')) AS tags
  FROM body),
means AS (SELECT *, CASE WHEN len(parts) = 0 THEN 0 ELSE list_sum([length(p) FOR p IN parts]) / len(parts) END AS mean FROM shape),
graded AS (
  SELECT doc_id, lang, n AS chars, len(parts) AS sentences, mean,
         CASE WHEN n < 200 THEN 'empty' WHEN readable < 0.85 THEN 'garbled' WHEN tags >= 2 THEN 'thin'
              WHEN n >= 2000 THEN 'usable' WHEN mean >= 30 THEN 'usable' ELSE 'thin' END AS grade
  FROM means)
"""


@query("grade_distribution", _GRADED + "SELECT grade, count(*) AS docs, sum(chars)::BIGINT AS chars, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM graded GROUP BY grade")
def grade_distribution(spark, sf_dir):
    graded = table(spark, sf_dir, "documents").select(F.inline(F.array(T.assessment(F.col("text")))))  # taken apart once, not once a field
    per = graded.groupBy("grade").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))
    total = per.agg(F.sum("docs").alias("total"))
    return per.join(F.broadcast(total)).select("grade", "docs", "chars", F.round(100.0 * F.col("docs") / F.col("total"), 1).alias("percent"))


@query("assess", _GRADED + "SELECT doc_id, grade, chars, CASE WHEN grade = 'empty' THEN 0 ELSE sentences END AS sentences, round(CASE WHEN grade = 'empty' THEN 0 ELSE mean END, 6) AS avg_sentence_chars FROM graded")
def assess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(T.assessment(F.col("text"))))).withColumn("avg_sentence_chars", F.round("avg_sentence_chars", 6))


@query("clean_text", r"""
SELECT page_id, md5(tagless) AS tagless, md5(regexp_replace(regexp_replace(decoded, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned, md5(regexp_replace(decoded, '[^a-zA-Z0-9\s.,]', '', 'g')) AS plain,
       CASE WHEN length(tagless) <= 100 THEN tagless ELSE substr(tagless, 1, 97) || '...' END AS teaser
FROM (SELECT page_id, tagless, replace(replace(replace(replace(replace(replace(replace(replace(tagless, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&#x2F;', '/') AS decoded
      FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS tagless FROM pages))
""")
def clean_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.remove_tags(F.col("html")).alias("t")).withColumn("d", T.decode_entities(F.col("t")))
    return pages.select("page_id", F.md5(F.col("t").cast("binary")).alias("tagless"), F.md5(T.collapse(F.col("d")).cast("binary")).alias("cleaned"), F.md5(T.keep_plain(F.col("d"), ".,").cast("binary")).alias("plain"), T.truncate(F.col("t"), 100).alias("teaser"))


@query("remove_contacts", r"""
SELECT doc_id, length(c) AS chars, md5(c) AS cleaned
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', '', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '', 'g'), '[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]', '', 'g') AS c FROM documents)
""")
def remove_contacts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", T.remove_contacts(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").alias("chars"), F.md5(F.col("c").cast("binary")).alias("cleaned"))


@query("readability", r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS words FROM documents),
m AS (
  SELECT doc_id, len(words) AS words,
         len(list_filter(regexp_split_to_array(t, '[.!?\x{3002}\x{ff01}\x{ff1f}]+'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS sentences,
         len(list_filter(string_split(t, E'\n\n'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS paragraphs,
         coalesce(list_sum([greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) FOR x IN words]), 0)::BIGINT AS syllables
  FROM w)
SELECT doc_id, words, sentences, paragraphs, syllables,
       CASE WHEN words > 0 AND sentences > 0 THEN round(greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words))), 6) END AS reading_ease,
       CASE WHEN words > 0 AND sentences > 0 THEN round(0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE, 6) END AS grade_level
FROM m
""")
def readability(spark, sf_dir):
    t = T.text_or_empty(F.col("text"))
    m = table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("words"), T.sentence_count(t).alias("sentences"), T.paragraph_count(t).alias("paragraphs"), T.syllables(t).cast("long").alias("syllables"))
    some = (F.col("words") > 0) & (F.col("sentences") > 0)
    args = (F.col("words"), F.col("sentences"), F.col("syllables"))
    return m.withColumn("reading_ease", F.when(some, F.round(T.reading_ease(*args), 6))).withColumn("grade_level", F.when(some, F.round(T.grade_level(*args), 6)))


_HITS = " + ".join(f"regexp_matches(low, '{p}')::INTEGER" for p in T.BOILERPLATE)


@query("quality_assessment", rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words FROM documents),
m AS (
  SELECT doc_id, len(words) AS n, (length(t) - length(replace(t, E'\n\n', ''))) // 2 + 1 AS paragraphs, {_HITS} AS hits,
         list_sum([length(x) FOR x IN words]) / nullif(len(words), 0) AS word_length,
         len(words) / greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?\x{{3002}}\x{{ff01}}\x{{ff1f}}]+'), lambda x: regexp_replace(x, '\s+', '', 'g') <> ''))) AS sentence_length
  FROM w),
s AS (
  SELECT doc_id, CASE WHEN n >= 500 THEN 1.0 WHEN n >= 200 THEN 0.7 WHEN n >= 50 THEN 0.4 ELSE 0.2 END::DOUBLE AS length_score,
         CASE WHEN paragraphs >= 5 THEN 1.0 WHEN paragraphs >= 3 THEN 0.7 WHEN paragraphs >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS structure_score,
         greatest(0, 1 - hits * 0.1::DOUBLE) AS boilerplate_score,
         CASE WHEN n = 0 THEN 0 ELSE least(1, (greatest(0, 1 - (word_length - 5) * 0.1::DOUBLE) + greatest(0, 1 - (sentence_length - 15) * 0.03::DOUBLE)) / 2) END AS readability_score
  FROM m)
SELECT doc_id, length_score, structure_score, round(boilerplate_score, 6) AS boilerplate_score, round(readability_score, 6) AS readability_score,
       round(length_score * 0.25::DOUBLE + structure_score * 0.2::DOUBLE + boilerplate_score * 0.2::DOUBLE + readability_score * 0.2::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE, 6) AS overall
FROM s
""")
def quality_assessment(spark, sf_dir):
    t = T.text_or_empty(F.col("text"))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    m = table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n"), (F.regexp_count(t, F.lit("\n\n")) + 1).alias("paragraphs"), T.boilerplate_hits(t).alias("hits"),
        F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).alias("letters"), T.sentence_count(t).alias("sentences"),
    )
    n = F.col("n")
    length = F.when(n >= 500, 1.0).when(n >= 200, 0.7).when(n >= 50, 0.4).otherwise(0.2)
    p = F.col("paragraphs")
    structure = F.when(p >= 5, 1.0).when(p >= 3, 0.7).when(p >= 2, 0.5).otherwise(0.3)
    zero = F.lit(0.0)
    boilerplate = F.greatest(zero, 1 - F.col("hits") * 0.1)
    readable = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.greatest(zero, 1 - (F.col("letters") / F.greatest(n, F.lit(1)) - 5) * 0.1) + F.greatest(zero, 1 - (n / F.greatest(F.lit(1), F.col("sentences")) - 15) * 0.03)) / 2))
    scores = m.select("doc_id", length.alias("length_score"), structure.alias("structure_score"), boilerplate.alias("b"), readable.alias("r"))
    overall = F.col("length_score") * 0.25 + F.col("structure_score") * 0.2 + F.col("b") * 0.2 + F.col("r") * 0.2 + 0.5 * 0.15
    return scores.select("doc_id", "length_score", "structure_score", F.round("b", 6).alias("boilerplate_score"), F.round("r", 6).alias("readability_score"), F.round(overall, 6).alias("overall"))


@query("language_detect", r"""
SELECT lang, found, count(*) AS docs FROM (
  SELECT lang, CASE WHEN len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) > 10 THEN 'zh' WHEN len(regexp_extract_all(t, '[\x{3040}-\x{30ff}]')) > 10 THEN 'ja'
    WHEN len(regexp_extract_all(t, '[\x{ac00}-\x{d7af}]')) > 10 THEN 'ko' WHEN len(regexp_extract_all(t, '[\x{0400}-\x{04ff}]')) > 10 THEN 'ru' WHEN regexp_matches(t, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS found
  FROM (SELECT lang, coalesce(text, '') AS t FROM documents)) GROUP BY lang, found
""")
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", T.script_language(T.text_or_empty(F.col("text"))).alias("found")).groupBy("lang", "found").agg(F.count(F.lit(1)).alias("docs"))


@query("token_estimate", r"""
SELECT conv_id, sum(CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, floor((length(t) - c) / 4 + c / 1.5)) END)::BIGINT AS tokens, count(*) AS turns
FROM (SELECT conv_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]')) AS c FROM conversations) GROUP BY conv_id
""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.tokens_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))


@query("content_windows", """
SELECT doc_id, s AS start, md5(substr(t, s + 1, 2000)) AS part, s + 2000 < length(t) AS has_more, least(s + 2000, length(t)) AS next_start, greatest(length(t) - s - 2000, 0) AS remaining
FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 2000))::INTEGER AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
""")
def content_windows(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.windows(T.text_or_empty(F.col("text")), 2000)).alias("w"))
    return w.select("doc_id", "w.start", F.md5(F.col("w.part").cast("binary")).alias("part"), "w.has_more", "w.next_start", "w.remaining")


@query("length_filter", "SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents WHERE length(text) BETWEEN 100 AND 100000 GROUP BY lang")
def length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text").between(100, 100_000)).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("json_select", """
SELECT event_type, count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(props->>'$.k') AS k_present, count(*) FILTER (WHERE props->>'$.missing' IS NULL) AS missing FROM events GROUP BY event_type
""")
def json_select(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k.cast("long")).alias("k_sum"), F.count(k).alias("k_present"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("missing"))


@query("cache_keys", "SELECT item_id, md5(lower(text) || '|10|' || 'a,b') AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    backends = F.array_join(F.array_sort(F.array(F.lit("b"), F.lit("a"))), ",")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat_ws("|", F.lower("text"), F.lit("10"), backends).cast("binary")).alias("key"))

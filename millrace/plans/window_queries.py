"""Scans, window frames and merges over events, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import web as U
from millrace.operators.retrieval import top
from millrace.plans.registry import query, table


@query("latest_events", "SELECT event_id, event_type, coalesce((props->>'$.k')::BIGINT, -1) AS k FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 10")
def latest_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(10).limit(100)
    return e.select("event_id", "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


@query("previous_turn", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars FROM conversations")
def previous_turn(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.sum(F.length("text")).over(w).alias("chars"))


@query("last_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 3").select("conv_id", "turn")


@query("any_failure", "SELECT user_id, event_type, bool_or(value < 5) AS failed, bool_and(value < 95) AS calm FROM events GROUP BY ALL")
def any_failure(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") < 5).alias("failed"), F.bool_and(F.col("value") < 95).alias("calm"))


@query("label_tally", "SELECT d.source, count(*) AS events, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 1) AS ambiguous, sum(least(greatest(length(d.text), 0), 10))::BIGINT AS expected FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def label_tally(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).join(table(spark, sf_dir, "labels").withColumn("one", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count("one").alias("labelled"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("ambiguous"), F.sum(F.least(F.greatest("n", F.lit(0)), F.lit(10))).alias("expected"))


@query("label_rows", """
WITH l AS (SELECT doc_id, unnest([CASE WHEN quality = 1 THEN {'label': 'good', 'confidence': 0.95} END, CASE WHEN toxic = 1 THEN {'label': 'toxic', 'confidence': 0.9} END, CASE WHEN quality = 0 AND toxic = 0 THEN {'label': NULL, 'confidence': NULL} END]) AS r FROM labels)
SELECT doc_id, r.label AS label, r.confidence::DOUBLE AS confidence FROM l WHERE r IS NOT NULL
""")
def label_rows(spark, sf_dir):
    row = lambda label, confidence: F.struct(F.lit(label).cast("string").alias("label"), F.lit(confidence).cast("double").alias("confidence"))
    found = F.filter(F.array(F.when(F.col("quality") == 1, row("good", 0.95)), F.when(F.col("toxic") == 1, row("toxic", 0.9)), F.when((F.col("quality") == 0) & (F.col("toxic") == 0), row(None, None))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "labels").select("doc_id", F.inline(found))


@query("prediction_dedup", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value >= 5) DESC, ts DESC NULLS LAST, event_id DESC) = 1")
def prediction_dedup(spark, sf_dir):
    """Valid before invalid, then the newest, then the last: one candidate a task by ``max_by``."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct((F.col("value") >= 5).alias("v"), "ts", "event_id")).alias("event_id"))


@query("merge_sources", r"""
WITH h AS (SELECT 'a' AS backend, page_id AS rank, url, length(html) AS n FROM pages UNION ALL SELECT 'b', 1000000 - page_id, url || '/', length(html) + 1 FROM pages WHERE page_id % 2 = 0)
SELECT rtrim(lower(url), '/') AS key, count(DISTINCT backend) AS backends, string_agg(DISTINCT backend, ',' ORDER BY backend) AS names, min(rank)::BIGINT AS rank, max(n)::BIGINT AS longest FROM h GROUP BY 1
""")
def merge_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"))
    a = p.select(F.lit("a").alias("backend"), F.col("page_id").alias("rank"), "url", "n")
    b = p.where("page_id % 2 = 0").select(F.lit("b").alias("backend"), (1_000_000 - F.col("page_id")).alias("rank"), F.concat("url", F.lit("/")).alias("url"), (F.col("n") + 1).alias("n"))
    per = a.unionByName(b).groupBy(F.rtrim(F.lower("url"), F.lit("/")).alias("key"), "backend").agg(F.min("rank").alias("rank"), F.max("n").alias("n"))
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("backends"), F.array_join(F.array_sort(F.collect_list("backend")), ",").alias("names"), F.min("rank").alias("rank"), F.max("n").cast("long").alias("longest"))


@query("site_rank", r"""
WITH s AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, count(*) AS pages, round(avg(length(html)), 4) AS size FROM pages GROUP BY 1)
SELECT host, pages, size, row_number() OVER (ORDER BY pages DESC, host) AS place, max(pages) OVER () - pages AS gap FROM s
""")
def site_rank(spark, sf_dir):
    s = table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.length("html")), 4).alias("size"))
    return s.select("host", "pages", "size", F.row_number().over(Window.orderBy(F.col("pages").desc(), "host")).alias("place"), (F.max("pages").over(Window.partitionBy()) - F.col("pages")).alias("gap"))


@query("snapshot_changes", "SELECT user_id, event_id, value <> lag(value) OVER w AS changed, lag(value) OVER w IS NULL AS baseline FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def snapshot_changes(spark, sf_dir):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") != before).alias("changed"), before.isNull().alias("baseline"))


@query("sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY ALL
""")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("session"), "events")


@query("sentence_dedup", r"""
WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?\n]+') AS parts FROM documents),
e AS (SELECT doc_id, trim(lower(regexp_replace(unnest(parts), '\s+', ' ', 'g'))) AS sentence FROM s)
SELECT doc_id, count(*) AS sentences, count(DISTINCT sentence) AS distinct_sentences FROM e WHERE sentence <> '' GROUP BY doc_id
""")
def sentence_dedup(spark, sf_dir):
    parts = F.filter(F.transform(F.split(T.text_or_empty(F.col("text")), r"[.!?\n]+"), lambda x: F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", parts.alias("p")).where(F.size("p") > 0)
    return d.select("doc_id", F.size("p").cast("long").alias("sentences"), F.size(F.array_distinct("p")).cast("long").alias("distinct_sentences"))

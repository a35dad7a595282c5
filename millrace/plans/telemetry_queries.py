"""Operational queries over ``events`` and ``labels``: an event type stands for a backend, ``value`` for a latency, a low value for a failure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import telemetry as T
from millrace.plans.registry import query, table

FAILED = "value < 5"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("backend_summary", f"""
SELECT event_type, count(*) AS attempts, count(*) FILTER (WHERE {FAILED}) AS failures, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  round(1.0 - count(*) FILTER (WHERE {FAILED}) / count(*), 4) AS success_rate FROM events GROUP BY event_type
""")
def backend_summary(spark, sf_dir):
    e = _events(spark, sf_dir)
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.expr(FAILED)).alias("failures"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"),
        F.round(1.0 - F.count_if(F.expr(FAILED)) / F.count(F.lit(1)), 4).alias("success_rate"),
    )


@query("percentile_rules", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (WHERE i = ceil(n * 0.95) - 1) AS nearest, min(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS rounded, min(value) FILTER (WHERE i = floor(0.95 * (n - 1))) AS floored,
  min(value) FILTER (WHERE i = least(n - 1, floor(n * 0.95))) AS clamped, round((min(value) FILTER (WHERE i = floor((n - 1) / 2)) + min(value) FILTER (WHERE i = floor(n / 2))) / 2, 9) AS median
FROM r GROUP BY event_type
""")
def percentile_rules(spark, sf_dir):
    return T.percentiles(_events(spark, sf_dir), "event_type", "value", 0.95).withColumn("median", F.round("median", 9))


@query("provider_score", f"""
WITH m AS (SELECT event_type, avg(CASE WHEN {FAILED} THEN 0.0 ELSE 1.0 END) AS success, quantile_disc(value * 10, 0.95) AS p95 FROM events GROUP BY event_type)
SELECT event_type, round(success * 40 + CASE WHEN p95 <= 200 THEN 100 WHEN p95 <= 500 THEN 80 WHEN p95 <= 2000 THEN 50 ELSE 20 END * 0.25 + success * 20 + 15, 6) AS score FROM m
""")
def provider_score(spark, sf_dir):
    m = _events(spark, sf_dir).groupBy("event_type").agg(F.avg(F.when(F.expr(FAILED), 0.0).otherwise(1.0)).alias("success"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value * 10)").alias("p95"))
    return m.select("event_type", F.round(T.provider_score(F.col("success"), F.col("p95"), 1 - F.col("success"), F.lit(100)), 6).alias("score"))


@query("failure_streaks", f"""
WITH i AS (SELECT event_id, user_id, ts, ({FAILED})::INTEGER AS f, sum(CASE WHEN {FAILED} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS run FROM i)
SELECT user_id, max(run) AS longest, count(*) FILTER (WHERE run >= 2) AS open_events FROM r GROUP BY user_id
""")
def failure_streaks(spark, sf_dir):
    runs = T.failure_runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.expr(FAILED), 2)
    return runs.groupBy("user_id").agg(F.max("run").alias("longest"), F.count_if("opened").alias("open_events"))


@query("rolling_24h", """
SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)
""")
def rolling_24h(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-86400, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("last_500", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50 FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500) GROUP BY event_type")
def last_500(spark, sf_dir):
    kept = T.latest(_events(spark, sf_dir), "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 500)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))


@query("slo_window", f"""
WITH e AS (SELECT *, max(ts) OVER () AS as_of FROM events), w AS (SELECT unnest([7, 30]) AS days)
SELECT days, count(*) AS attempts, round(1.0 - count(*) FILTER (WHERE {FAILED}) / count(*), 6) AS success_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  CASE WHEN 1.0 - count(*) FILTER (WHERE {FAILED}) / count(*) < 0.90 THEN 'violating' WHEN quantile_disc(value, 0.95) > 90 THEN 'warning' ELSE 'meeting' END AS status
FROM e JOIN w ON e.ts >= e.as_of - to_days(days::INTEGER) GROUP BY days
""")
def slo_window(spark, sf_dir):
    e = _events(spark, sf_dir)
    as_of = e.agg(F.max("ts").alias("as_of"))
    days = F.explode(F.array(F.lit(7), F.lit(30))).alias("days")
    rows = e.join(F.broadcast(as_of)).select("value", "ts", "as_of", days).where(F.expr("ts >= as_of - make_dt_interval(days)"))
    rate = 1.0 - F.count_if(F.expr(FAILED)) / F.count(F.lit(1))
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    a = rows.groupBy("days").agg(F.count(F.lit(1)).alias("attempts"), rate.alias("r"), p(0.5).alias("p50"), p(0.95).alias("p95"))
    return a.select("days", "attempts", F.round("r", 6).alias("success_rate"), "p50", "p95", F.when(F.col("r") < 0.90, "violating").when(F.col("p95") > 90, "warning").otherwise("meeting").alias("status"))


@query("daily_counts", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_histogram", "SELECT event_type, b AS bound, count(*) FILTER (WHERE value <= b) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0])::DOUBLE AS b) GROUP BY ALL")
def event_histogram(spark, sf_dir):
    """Cumulative buckets: a value is counted at its own bound first, and bounds are summed afterwards."""
    bounds = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]
    counts = _events(spark, sf_dir).groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])))


@query("ab_pairing", """
WITH a AS (SELECT user_id, min(value) AS a FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, min(value) AS b FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, a, b, round(b - a, 9) AS delta FROM a JOIN b USING (user_id)
""")
def ab_pairing(spark, sf_dir):
    return T.paired(_events(spark, sf_dir), "user_id", "event_type", "value", "click", "view").withColumn("delta", F.round("delta", 9))


@query("reconciliation", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 99)
SELECT a.user_id IS NOT NULL AS in_a, b.user_id IS NOT NULL AS in_b, count(*) AS pairs FROM a FULL JOIN b USING (user_id) GROUP BY ALL
""")
def reconciliation(spark, sf_dir):
    e = _events(spark, sf_dir)
    both = T.reconcile(e.where("event_type = 'purchase'"), e.where("value > 99"), ["user_id"])
    return both.groupBy("in_a", "in_b").agg(F.count(F.lit(1)).alias("pairs"))


_SCORED = r"""
WITH s AS (SELECT l.doc_id, l.quality, round(least(1, length(d.text) / 2000.0::DOUBLE), 4) AS score FROM labels l JOIN documents d USING (doc_id))
"""


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(X.text_or_empty(F.col("text"))).alias("n"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", F.round(F.least(F.lit(1.0), F.col("n") / 2000.0), 4).alias("score"))


@query("confusion", _SCORED + """
, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= 0.5) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality <> 1 AND score < 0.5) AS tn FROM s)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c
""")
def confusion(spark, sf_dir):
    return T.confusion(_scored(spark, sf_dir), "quality", "score")


@query("brier", _SCORED + "SELECT count(*) AS n, round(avg((score - quality) * (score - quality)), 5) AS brier FROM s")
def brier(spark, sf_dir):
    d = F.col("score") - F.col("quality")
    return _scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d * d), 5).alias("brier"))


@query("calibration", _SCORED + """
, b AS (SELECT least(4, floor(score * 5))::INTEGER AS bin, count(*) AS n, round(avg(score), 6) AS mean, round(avg(quality), 6) AS positives FROM s GROUP BY 1)
SELECT r.bin::INTEGER AS bin, coalesce(n, 0) AS n, mean, positives FROM (SELECT unnest(range(5))::INTEGER AS bin) r LEFT JOIN b USING (bin)
""")
def calibration(spark, sf_dir):
    return T.calibration(_scored(spark, sf_dir), "quality", "score")


@query("join_report", "SELECT d.lang, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def join_report(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("one"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("one").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))

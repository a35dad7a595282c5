"""Service-level reports: events stand for searches and fetches, by rules that both engines share."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import slo
from millrace.plans.registry import query, table

_CALLS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS moment, CASE WHEN event_type IN ('click', 'view') THEN 'search' ELSE 'fetch' END AS kind, user_id % 41 <> 0 AS ok, value * 55.0 AS latency,
  CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN user_id % 11 = 0 THEN 'thin' WHEN user_id % 17 = 0 THEN 'empty' WHEN user_id % 23 = 0 THEN 'garbled' ELSE 'usable' END AS grade, user_id % 3 = 0 AS truncated
FROM events
"""


def _calls(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_CALLS).withColumnRenamed("moment", "at")


@query("rolling_slo", f"""
WITH c AS ({_CALLS}), w AS (SELECT unnest([7, 30]) AS days),
e AS (SELECT days, c.* FROM c, w, (SELECT max(moment::DATE) AS last FROM c) WHERE moment::DATE > last - days::INTEGER),
a AS (
  SELECT days, count(*) FILTER (kind = 'search') AS st, count(*) FILTER (kind = 'search' AND ok) AS ss, count(*) FILTER (kind = 'fetch') AS ft, count(*) FILTER (kind = 'fetch' AND ok) AS fs,
    quantile_disc(latency, 0.5) FILTER (kind = 'search') AS s50, quantile_disc(latency, 0.95) FILTER (kind = 'search') AS s95, quantile_disc(latency, 0.5) FILTER (kind = 'fetch') AS f50, quantile_disc(latency, 0.95) FILTER (kind = 'fetch') AS f95,
    count(grade) AS g, count(*) FILTER (grade = 'usable') AS gu, count(*) FILTER (grade = 'thin') AS gt, count(*) FILTER (grade = 'garbled') AS gg, count(*) FILTER (grade = 'empty') AS ge, count(*) FILTER (grade IS NOT NULL AND truncated) AS gc
  FROM e GROUP BY days
),
r AS (SELECT *, ss * 100.0::DOUBLE / nullif(st, 0) AS sr, fs * 100.0::DOUBLE / nullif(ft, 0) AS fr, gu * 100.0::DOUBLE / nullif(g, 0) AS ur, gt * 100.0::DOUBLE / nullif(g, 0) AS tr, gc * 100.0::DOUBLE / nullif(g, 0) AS cr,
  CASE days WHEN 7 THEN 99.0 ELSE 98.0 END AS sw, CASE days WHEN 7 THEN 98.0 ELSE 97.0 END AS fw FROM a),
v AS (SELECT *, coalesce(sr < sw, false) AS low_s, coalesce(fr < fw, false) AS low_f, days = 7 AND coalesce(s95 > 5000, false) AS slow FROM r)
SELECT days::INTEGER AS days,
  CASE WHEN ur < 85 THEN 'violating' WHEN slow THEN 'warning' WHEN low_s OR low_f THEN 'violating' WHEN tr > 10 THEN 'warning' WHEN st + ft + g = 0 THEN 'no_data' ELSE 'healthy' END AS status,
  array_to_string(list_filter([CASE WHEN low_s THEN 'search success' END, CASE WHEN low_f THEN 'fetch success' END, CASE WHEN slow THEN 'search p95' END, CASE WHEN ur < 85 THEN 'usable content' END, CASE WHEN tr > 10 THEN 'thin content' END], lambda x: x IS NOT NULL), ', ') AS violations,
  CASE WHEN cr > 25 THEN 'truncation' END AS notes, st AS search_total, ss AS search_successful, ft AS fetch_total, fs AS fetch_successful,
  round(sr, 2) AS search_rate, round(fr, 2) AS fetch_rate, round(ur, 2) AS usable_rate, round(tr, 2) AS thin_rate, round(gg * 100.0::DOUBLE / nullif(g, 0), 2) AS garbled_rate, round(ge * 100.0::DOUBLE / nullif(g, 0), 2) AS empty_rate, round(cr, 2) AS truncated_rate,
  round(s50, 1) AS search_p50, round(s95, 1) AS search_p95, round(f50, 1) AS fetch_p50, round(f95, 1) AS fetch_p95
FROM v
""")
def rolling_slo(spark, sf_dir):
    """Windows of 7 and 30 days: counts from daily rows, latencies by the exact rule."""
    calls = _calls(spark, sf_dir)
    last = F.to_timestamp(F.lit(calls.agg(F.max(F.to_date("at"))).first()[0]))
    windows = slo.merged(slo.daily(calls), last).drop("p50", "p95")
    days = calls.select("*", F.explode(F.array(F.lit(7), F.lit(30))).alias("days")).where((F.to_date("at").cast("timestamp") > last - F.make_dt_interval("days")))
    exact = slo.exact_quantiles(days, ["days", "kind"], "latency", (0.5, 0.95)).groupBy("days", "kind").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))])
    return slo.report(windows.join(exact, ["days", "kind"], "left")).withColumn("violations", F.array_join("violations", ", "))


@query("exact_quantiles", """
SELECT event_type, p, CASE p WHEN 0.01 THEN quantile_disc(value, 0.01) WHEN 0.5 THEN quantile_disc(value, 0.5) WHEN 0.9 THEN quantile_disc(value, 0.9) ELSE quantile_disc(value, 0.999) END AS value
FROM events, (SELECT unnest([0.01, 0.5, 0.9, 0.999])::DOUBLE AS p) GROUP BY event_type, p
""")
def exact_quantiles(spark, sf_dir):
    return slo.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.01, 0.5, 0.9, 0.999))

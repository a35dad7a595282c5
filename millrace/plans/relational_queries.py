"""Relational queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.operators.retrieval import top
from millrace.plans.registry import query, table


@query("grouped_report", """
SELECT o_orderstatus, o_orderpriority, CASE WHEN GROUPING(o_orderstatus) = 0 AND GROUPING(o_orderpriority) = 0 THEN 'o_orderstatus,o_orderpriority' WHEN GROUPING(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN GROUPING(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE '' END AS "grouping",
  count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())
""")
def grouped_report(spark, sf_dir):
    return R.grouped_report(table(spark, sf_dir, "orders"), [("o_orderstatus",), ("o_orderpriority",), ("o_orderstatus", "o_orderpriority"), ()], F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("merge_upsert", """
WITH n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT -o_orderkey - 1, 1.0 FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, o_totalprice FROM n UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
""")
def merge_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")).unionByName(o.where("o_orderstatus = 'P'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")))
    return R.merged(o.select("o_orderkey", "o_totalprice"), new, ["o_orderkey"])


@query("retention", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))))
    return R.retained(rows, "ts", 7, F.col("as_of")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("size_cap", "SELECT lang, doc_id FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM documents) WHERE s <= 50000")
def size_cap(spark, sf_dir):
    return R.size_capped(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars", [F.col("doc_id").desc()], 50_000).select("lang", "doc_id")


@query("set_report", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS "both", count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b FROM a FULL JOIN b USING (k)
""")
def set_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.set_report(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query("topk_per_group", "SELECT c_nationkey, c_custkey, total, rank FROM (SELECT c_nationkey, c_custkey, total, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS rank FROM (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return top(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").join(spent, "c_custkey"), "c_nationkey", "total", "c_custkey", 3)


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))

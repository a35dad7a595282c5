"""Service-level reports: exact quantiles, report files of both layouts, rolling windows in batch and behind a stream."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import slo

DAY = dt.datetime(2024, 3, 1)


def nearest(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(len(v) * p)) - 1]


@pytest.mark.parametrize("error", [slo.ERROR, 0.05, -0.2])  # the last gives brackets that miss, so all is done again
def test_exact_quantiles_by_sorting(spark, error):
    rng = random.Random(2)
    groups = {"wide": [rng.gauss(0, 1) for _ in range(4000)], "ties": [float(rng.randint(0, 3)) for _ in range(4000)], "one": [7.0], "hot": [1.0] * 3000 + [2.0] * 3, "two": [-1.0, 5.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "kind string, latency double")
    ps = (0.0, 0.001, 0.5, 0.95, 1.0)
    found = {(r["kind"], r["p"]): r["value"] for r in slo.exact_quantiles(df.where("kind is not null"), ["kind"], "latency", ps, error, 200).collect()}
    assert found == {(g, p): nearest(vs, p) for g, vs in groups.items() for p in ps}
    assert slo.exact_quantiles(df.limit(0), ["kind"], "latency", ps).count() == 0


def calls(spark, rows):
    return spark.createDataFrame(rows, "at timestamp, kind string, ok boolean, latency double, grade string, truncated boolean")


def some_calls(seed, n=3000):
    rng = random.Random(seed)
    return [(DAY - dt.timedelta(minutes=rng.randrange(40 * 1440)), rng.choice(["search", "fetch"]), rng.random() < 0.97, rng.expovariate(1 / 900), rng.choice([None, "usable", "usable", "thin"]), rng.random() < 0.1) for _ in range(n)]


def test_windows_merge_days_within_the_sketch_error(spark):
    rows = some_calls(1)
    windows = {(r["days"], r["kind"]): r for r in slo.merged(slo.daily(calls(spark, rows)), F.lit(DAY)).collect()}
    for (days, kind), r in windows.items():
        first = (DAY - dt.timedelta(days=days)).date()
        mine = [x for x in rows if x[1] == kind and first < x[0].date() <= DAY.date()]
        assert (r["total"], r["successful"], r["graded"], r["thin"]) == (len(mine), sum(x[2] for x in mine), sum(x[4] is not None for x in mine), sum(x[4] == "thin" for x in mine))
        values = sorted(x[3] for x in mine)
        for p in (0.5, 0.95):
            rank = sum(v <= r[f"p{round(p * 100)}"] for v in values) / len(values)
            assert abs(rank - p) <= slo.ERROR + 1 / len(values)


def test_stream_of_days_equals_the_batch(spark, tmp_path):
    rows = some_calls(2, 600)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    calls(spark, [r for r in rows if r[0].day % 2]).coalesce(1).write.parquet(source)
    calls(spark, [r for r in rows if not r[0].day % 2]).coalesce(1).write.mode("append").parquet(source)
    calls(spark, [(DAY + dt.timedelta(days=90), "fetch", True, 1.0, None, False)]).write.mode("append").parquet(source)  # moves the watermark on
    stream = spark.readStream.schema(calls(spark, []).schema).parquet(source)
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing twice
        slo.daily(stream, "60 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    plain = lambda df: sorted(tuple(r) for r in df.select("days", "kind", "total", "successful", "usable", "truncated").collect())
    assert plain(slo.merged(spark.read.parquet(out), F.lit(DAY))) == plain(slo.merged(slo.daily(calls(spark, rows)), F.lit(DAY)))


def windows(spark, **values):
    base = {"total": 0, "successful": 0, "p50": None, "p95": None, **{g: 0 for g in slo.GRADES}, "graded": 0, "truncated": 0}
    rows = [(values["days"], k, *(base | values.get(k, {})).values()) for k in ("search", "fetch") if k in values]
    return slo.report(spark.createDataFrame(rows, "days int, kind string, total long, successful long, p50 double, p95 double, usable long, thin long, garbled long, empty long, graded long, truncated long")).first()


def test_status_by_targets(spark):
    fine = {"total": 1000, "successful": 1000, "p50": 10.0, "p95": 20.0}
    r = windows(spark, days=7, search=fine, fetch=fine)
    assert (r["status"], r["violations"], r["usable_rate"], r["search_p95"]) == ("healthy", [], None, 20.0)
    assert windows(spark, days=7, search=fine | {"successful": 985})["violations"] == ["search success"]
    assert windows(spark, days=30, search=fine | {"successful": 985})["status"] == "healthy"
    r = windows(spark, days=7, search=fine | {"successful": 0, "p95": 6000.0})
    assert (r["status"], r["violations"]) == ("warning", ["search success", "search p95"])
    assert windows(spark, days=30, search=fine | {"p95": 6000.0})["status"] == "healthy"
    assert windows(spark, days=7, fetch=fine | {"graded": 100, "usable": 80, "thin": 20})["violations"] == ["usable content", "thin content"]
    r = windows(spark, days=30, fetch=fine | {"graded": 100, "usable": 88, "thin": 12, "truncated": 30})
    assert (r["status"], r["violations"], r["notes"]) == ("warning", ["thin content"], "truncation")
    r = windows(spark, days=7, search={}, fetch={})
    assert (r["status"], r["violations"], r["search_rate"], r["search_p50"]) == ("no_data", ["no observations"], None, 0.0)


def test_reports_of_both_layouts(spark):
    texts = [
        {"timestamp": 1709251200.5, "search_stats": {"total": 4, "successful": 3, "latencies_ms": [1, 2.5], "fallback_count": 1, "error_types": {"dns": 1}}, "error_types": {"dns": 2}},
        {"run_time": "2024-03-01T02:00:00Z", "search": {"count": 5, "success_count": 5, "p50_latency_ms": 10, "p95_latency_ms": 90, "providers": {"a": 3}}, "fallback": {"success_count": 2}, "provider_distribution": {"a": 1, "b": 1}},
        {"timestamp": "1709251200", "fetch": {"total": 1, "success": 1, "latencies_ms": 7}, "content_quality": {"fetches": 9, "usable": 8, "thin": 1}},
        {"fetch": {"latencies_ms": []}},
    ]
    df = slo.read_reports(spark.createDataFrame([(json.dumps(t),) for t in texts] + [("{broken",), (None,)], "value string"))
    rows = df.select("*", F.unix_timestamp("at").alias("t")).collect()
    by = {(r["t"], r["search_total"]): r for r in rows if r["t"] or r["has_quality"] or r["search_total"] or r["fetch_total"]}
    assert len(rows) == 4
    a, b, c = by[1709251200, 4], by[1709258400, 5], by[1709251200, 0]
    assert (a["search_successful"], a["search_samples"], a["fallbacks"]) == (3, [1.0, 2.5], 1)
    assert (b["search_successful"], b["search_samples"], b["fallbacks"]) == (5, [10.0, 90.0], 2)
    assert (c["fetch_total"], c["fetch_samples"], c["has_quality"], c["usable"], c["garbled"]) == (1, [7.0], True, 8, 0)
    assert {tuple(r) for r in slo.tallies(df, "errors").collect()} == {("dns", 3)} and {tuple(r) for r in slo.tallies(df, "providers").collect()} == {("a", 4), ("b", 1)}


def test_a_time_that_cannot_be_read_is_an_error(spark):
    with pytest.raises(Exception, match="cannot read the time"):
        slo.read_reports(spark.createDataFrame([(json.dumps({"timestamp": "yesterday"}),)], "value string")).collect()

"""Sources, sinks and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers as R
from millrace.sources import writers as W
from millrace.streaming import monitors as M


def test_feeds_and_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss version='2.0'><channel><title>News</title><item><title>One</title><link>http://x.org/1</link><pubDate>today</pubDate></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><title>Log</title><entry><title>Two</title><link href='http://x.org/2'/><updated>now</updated></entry></feed>")
    (tmp_path / "c.xml").write_text("<rss><channel><item>")
    assert {(r.kind, r.feed_title, r.title, r.link, r.published) for r in R.read_feeds(spark, str(tmp_path)).collect()} == {("rss", "News", "One", "http://x.org/1", "today"), ("atom", "Log", "Two", "http://x.org/2", "now")}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "map.xml").write_text("<urlset><url><loc>http://X.org/a/</loc><priority>0.5</priority></url><url><loc>http://x.org/a</loc><priority>bad</priority></url></urlset>")
    assert R.read_sitemaps(spark, str(tmp_path / "s")).count() == 1


def test_document_types_are_refused(spark, tmp_path):
    bomb = "<!DOCTYPE a [<!ENTITY x 'ha'><!ENTITY y '&x;&x;'>]>"
    (tmp_path / "a.xml").write_text(f"{bomb}<rss version='2.0'><channel><title>&y;</title><item><title>One</title><link>http://x.org/1</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss version='2.0'><channel><title>T</title><item><title>Two</title><link>http://x.org/2</link></item></channel></rss>")
    assert [r.title for r in R.read_feeds(spark, str(tmp_path)).collect()] == ["Two"]
    assert R.parse_sitemap(f"{bomb}<urlset><url><loc>http://x.org/</loc></url></urlset>") == [] == R.parse_sitemap("<urlset")


def test_reports_skip_corrupt_files(spark, tmp_path):
    for name, text in (("a", '{"n": 1,\n "search": {"count": 2}}'), ("b", '{"n": 2'), ("c", '{"n": 3}')):
        (tmp_path / "deep" / name).mkdir(parents=True)
        (tmp_path / "deep" / name / "live_report.json").write_text(text)
    (tmp_path / "deep" / "other.json").write_text('{"n": 9}')
    rows = R.read_reports(spark, str(tmp_path)).select("n", "source_file").collect()
    assert sorted((r.n, r.source_file.split("/")[-2]) for r in rows) == [(1, "a"), (3, "c")]


def test_observations_take_defaults(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"case_id": "001:docs", "arm": "a", "ok": true, "returned_chars": 5}\n{"case_id": "001:docs", "arm": "b"}\n')
    rows = {r.arm: r for r in R.read_observations(spark, str(tmp_path)).collect()}
    assert rows["a"].returned_chars == 5 and rows["b"].ok is False and rows["b"].latency_ms is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, ["x"]), (None, None, None)], "name string, score double, tags array<string>")
    assert [r.line for r in W.markdown_rows(df).collect()] == ['| a\\|b | 1.5 | ["x"] |', "|  |  |  |"]
    assert W.html_rows(spark.createDataFrame([("<b>&",)], "x string")).first().line == "<tr><td>&lt;b&gt;&amp;</td></tr>"
    for kind in W.FORMATS:
        W.export(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        W.export(df, "", "parquet")
    with pytest.raises(ValueError):
        W.export(df, str(tmp_path / "x"), "xlsx")
    metrics = spark.createDataFrame([("hits", {"b": "2", "a": "1"}, 3.0), ("up", {}, 1.0)], "name string, labels map<string,string>, value double")
    assert [r.line for r in W.exposition(metrics).collect()] == ['hits{a="1",b="2"} 3.0', "up 1.0"]


def stream(spark, df, tmp_path, name, query):
    path = str(tmp_path / name)
    df.write.parquet(path)
    source = spark.readStream.schema(df.schema).parquet(path)
    q = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_change_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("u", at(0), "a"), ("u", at(1), "a"), ("u", at(2), "b"), ("v", at(0), None), ("v", at(1), "")], "url string, ts timestamp, text string")
    got = stream(spark, df, tmp_path, "change_log", M.changes)
    assert sorted((r.url, r.version, r.baseline) for r in got) == [("u", 0, True), ("u", 1, False), ("v", 0, True)]


def test_first_seen_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [("a", at(0), 1), ("b", at(1), 2), ("a", at(2), 3), (None, at(3), 4), (None, at(4), 5), ("c", at(5), 6)]
    got = stream(spark, spark.createDataFrame(rows, "k string, ts timestamp, n int").coalesce(1), tmp_path, "seen_log", lambda s: M.first_seen(s, ["k"], "ts"))
    assert sorted(r.k or "" for r in got) == ["", "a", "b", "c"]


def test_circuit_breaker_stream(spark, tmp_path):
    rows = [("x", float(i), False) for i in range(5)] + [("x", 30.0, True), ("x", 70.0, False), ("x", 140.0, True)]
    got = stream(spark, spark.createDataFrame(rows, "backend string, at double, ok boolean"), tmp_path, "breaker_log", M.circuit_breaker)
    assert [(r.at, r.was, r.phase) for r in sorted(got, key=lambda r: r.at)] == [(4.0, "closed", "open"), (140.0, "open", "closed")]


def test_rolling_health_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    df = spark.createDataFrame([("a", at(1), 1.0), ("a", at(2), 9.0), ("a", at(60), 9.0)], "g string, ts timestamp, value double")
    got = stream(spark, df, tmp_path, "health_log", lambda s: M.rolling_health(s, "g", "ts", "value", F.col("value") < 5, "24 hours", "24 hours"))
    assert [(r.attempts, r.failures) for r in got if r.since == at(0)] == [(2, 1)]

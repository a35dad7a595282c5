"""Recovery rules: single responses, the table's own findings, and coverage."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from millrace.operators import recovery as R
from millrace.plans.catalog import QUERIES

FIELDS = [f.split()[0] for f in R.RESPONSE.split(", ")]
PROSE = "The gauge reads the height of the sea every hour of the day. " * 40


def decided(spark, *cases):
    rows = [tuple(c.get(f, {"status": 200, "content_type": "text/html"}.get(f)) for f in FIELDS) + (i, "x") for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"{R.RESPONSE}, i int, note string")
    return [(r["rule"], r["reason"], r["action"], r["confidence"]) for r in R.decide(df).orderBy("i").collect()]


def test_single_responses(spark):
    cases = {
        ("too_many", "RATE_LIMITED", "RETRY_LATER", 0.9): dict(error="slow down", error_code="FETCH_RATE_LIMITED"),
        ("timeout", "TIMEOUT", "RETRY", 0.85): dict(status=None, error="Connection TIMEOUT"),
        ("tls", "TLS_FAILURE", "PROVIDER_FALLBACK", 0.85): dict(error_code="FETCH_SSL_ERROR", error="connect"),
        ("network", "NETWORK_FAILURE", "RETRY", 0.8): dict(error="cannot connect"),
        ("server", "SERVER_ERROR", "RETRY", 0.8): dict(status=500, content=PROSE),
        ("denied_challenge", "SOFT_BLOCK", "BROWSER", 0.9): dict(error="no", error_code="FETCH_FORBIDDEN", content="Checking your browser"),
        ("denied_login", "ACCESS_DENIED", "STOP", 0.85): dict(status=403, raw_html="<p>Please sign in</p>" + PROSE),
        ("denied", "ACCESS_DENIED", "STOP", 0.8): dict(status=403, raw_html=" " * 400),
        ("missing", "ACCESS_DENIED", "STOP", 0.85): dict(status=410, error="gone", error_code="FETCH_NOT_FOUND"),
        ("accepted_usable", "COMPLETE_CONTENT", "ACCEPT", 0.8): dict(status=202, content=PROSE),
        ("accepted_unusable", "SOFT_BLOCK", "BROWSER", 0.85): dict(status=202),
        ("login_wall", "AUTH_REQUIRED", "REQUIRE_AUTH", 0.85): dict(content=PROSE + "请先登录"),
        ("challenge", "CHALLENGE", "BROWSER", 0.95): dict(content="human verification", raw_html="<p>x</p>"),
        ("unextracted_visible", "COMPLETE_SHORT_PAGE", "ACCEPT", 0.8): dict(content=f"<html>{PROSE}</html>", extracted=False, truncated=True),
        ("truncated", "OUTPUT_TRUNCATED", "CONTINUE_CONTENT", 0.95): dict(content=f"<html>{PROSE}</html>", extracted=False, extraction_status="unavailable", truncated=True),
        ("unextracted", "LOW_CONTENT_DENSITY", "BROWSER", 0.7): dict(content="<!DOCTYPE html><div></div><script>" + PROSE + "</script>", extracted=False, status=204),
        ("no_content", "AMBIGUOUS", "NONE", 0.4): dict(),
        ("short_page", "COMPLETE_SHORT_PAGE", "ACCEPT", 0.8): dict(content="words", status=None),
        ("complete", "COMPLETE_CONTENT", "ACCEPT", 0.85): dict(content=PROSE),
    }
    assert decided(spark, *cases.values()) == list(cases)


def test_markers_beyond_the_head_do_not_count(spark):
    far = "x" * R.HEAD + " captcha " + PROSE
    assert decided(spark, dict(content=far), dict(content="captcha " + far))[0][0] == "complete"


@pytest.mark.parametrize("marker", ["captcha", "登录/注册", "cf-browser-verification"])
def test_markers_are_plain_text(spark, marker):
    row = spark.range(1).select(R._holds_any(F.lit(f"a {marker} b"), R.CHALLENGE + R.LOGIN).alias("a"), R._holds_any(F.lit("login . register"), R.LOGIN).alias("b")).first()
    assert row["a"] and not row["b"]


def test_tables_are_sound_and_faults_are_found():
    assert R.findings() == []
    rules = (*R.RULES, R.Rule("legal", R._denied, "UNHEARD", action="GO"))
    reasons = R.REASONS | {"SPARE": ("BROWSER", 1.0, False), "JS_REQUIRED": ("RETRY", 0.9, True)}
    assert sorted(R.findings(rules, reasons)) == sorted(["legal: unknown reason UNHEARD", "legal: unknown action GO", "JS_REQUIRED: calls for a browser but its action is RETRY", "SPARE: no rule gives this reason", "legal: name given twice"])


def test_every_rule_decides_a_derived_response(spark):
    rows = QUERIES["recovery_coverage"](spark, "/root/testdata/sf0.001").collect()
    assert [r["rule"] for r in sorted(rows, key=lambda r: r["place"])] == [r.name for r in R.RULES]
    assert all(r["decided"] > 0 and r["held"] == r["decided"] + r["overlapped"] for r in rows)


def test_unreachable_rules_are_told(spark):
    rules = (R.RULES[-1], dataclasses.replace(R.RULES[0], name="late"))
    df = spark.createDataFrame([tuple({"status": 451}.get(f) for f in FIELDS)], R.RESPONSE)
    rows = {r["rule"]: r for r in R.coverage(df, rules).collect()}
    assert rows["late"]["unreachable"] and not rows["complete"]["unreachable"]
    assert R.coverage(df.limit(0), rules).collect()[0]["held"] == 0

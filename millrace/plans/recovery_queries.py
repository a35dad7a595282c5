"""Decisions about responses. ``pages`` has bodies only, so each page becomes a response that its id determines."""

from __future__ import annotations

from millrace.operators import recovery as R
from millrace.plans.registry import query, table
from millrace.plans.text_queries import _GRADED

_PROSE = "repeat('The tide gauge reads the height of the sea. ', 60)"
_SCRIPT = "'<script>' || repeat('var tide = 1; ', 400) || '</script>'"

#: Responses of 33 kinds, one for each way to decide, in words that both engines understand: (condition, columns).
_KINDS = (
    dict(status="451"), dict(status="CASE WHEN page_id % 2 = 0 THEN 401 ELSE 407 END"), dict(status="429"), dict(status="202", content=_PROSE), dict(status="202", content="'x'"), dict(status="0", error="'Read Timeout'"), dict(status="504"),
    dict(status="0", error="'SSL handshake'"), dict(status="0", error="'DNS lookup of ' || url"), dict(status="503"), dict(status="403", raw="'<p>Just a moment</p>' || html"), dict(status="403", type="'application/pdf'"), dict(status="403", raw="'Please log in'"),
    dict(status="403", raw="html"), dict(status="403"), dict(status="404"), dict(status="0", error="'denied by robots.txt'"), dict(status="0", error="'odd'", retryable="true"), dict(status="0", error="'odd'"), dict(type="'image/png'"),
    dict(content=_PROSE, truncated="true"), dict(raw="'<p>Forgot password</p>'"), dict(content="'solve the CAPTCHA'"), dict(raw="'<b>Please enable JavaScript</b>'"), dict(content="'few words'", raw=f"'<p>few words</p>' || {_SCRIPT}"),
    dict(content=_PROSE, raw=f"'<p>' || {_PROSE} || '</p>'", quality="'low'"), dict(content="'  '"), dict(content="html", raw="html", extracted="false"), dict(content="'<html><div id=root></div></html>'", extracted="false"),
    dict(content="repeat('words ', 50)", raw=f"repeat('<p>words</p>', 1500) || {_SCRIPT}"), dict(content="'menu'", raw="repeat('<p>words</p>', 2000)"), dict(content="substr(html, 1, 30) || ' a short page'", raw="'<p>a short page</p>'"), dict(content=_PROSE, raw=f"'<p>' || {_PROSE} || '</p>'"),
)


def _of(part: str, plain: str) -> str:
    return "CASE page_id % 33 " + " ".join(f"WHEN {i} THEN {k[part]}" for i, k in enumerate(_KINDS) if part in k) + f" ELSE {plain} END"


RESPONSES = f"""
SELECT page_id, {_of("status", "200")} AS status, {_of("error", "NULL")} AS error, '' AS error_code, {_of("retryable", "false")} AS retryable, {_of("type", "'text/html; charset=utf-8'")} AS content_type,
  {_of("content", "''")} AS content, {_of("raw", "''")} AS raw_html, {_of("extracted", "true")} AS extracted, 'empty' AS extraction_status, {_of("truncated", "false")} AS truncated, {_of("quality", "''")} AS content_quality
FROM pages
"""


def _any(x: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def _share(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE list_sum(list_transform(regexp_extract_all({x}, '(?is)<script\\b[^>]*>.*?</script\\b[^>]*>'), lambda s: length(s)))::DOUBLE / length({x}) END"


_L = R.LIMITS
_FEATURES = f"""
graded AS (SELECT doc_id AS page_id, grade FROM ({_GRADED.replace("FROM documents", "FROM (SELECT page_id AS doc_id, '' AS lang, content AS text FROM responses)")} SELECT * FROM graded)),
f0 AS (SELECT *, lower(coalesce(error, '')) AS said, error IS NOT NULL AS failed, CASE WHEN raw_html <> '' THEN raw_html ELSE content END AS html, lower(content_type) AS type FROM responses JOIN graded USING (page_id)),
f AS (
  SELECT *, length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) AS bare, NOT regexp_matches(content, '\\S') AS blank, regexp_matches(type, '^({"|".join(R.NOT_HTML)})') AS other_type,
    {_any("lower(substr(html, 1, 4096))", R.CHALLENGE)} AS challenged, {_any("lower(substr(content, 1, 4096))", R.CHALLENGE)} AS challenged_text, {_any("lower(substr(html, 1, 4096))", R.NEEDS_SCRIPT)} AS needs_script,
    {_any("lower(substr(html, 1, 48000))", R.LOGIN)} AS login, coalesce({_share("raw_html")}, 0) AS script_share, coalesce({_share("html")}, 0) AS any_script_share,
    contains(type, 'html') AND NOT extracted AND regexp_matches(lower(substr(content, 1, 2000)), '<html|<!doctype') AS unextracted,
    length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS visible
  FROM f0
)"""
#: The same table of rules as SQL: name, condition, reason, action, confidence.
_RULES = (
    ("legal", "status = 451", "LEGAL_OR_GEO_BLOCK", "STOP", 0.95), ("unauthorised", "status IN (401, 407)", "AUTH_REQUIRED", "REQUIRE_AUTH", 0.95), ("too_many", "status = 429", "RATE_LIMITED", "RETRY_LATER", 0.9),
    ("accepted_usable", "status = 202 AND grade = 'usable'", "COMPLETE_CONTENT", "ACCEPT", 0.8), ("accepted_unusable", "status = 202", "SOFT_BLOCK", "BROWSER", 0.85),
    ("timeout", "contains(said, 'timeout') OR status IN (408, 504)", "TIMEOUT", "RETRY", 0.85), ("tls", "contains(said, 'ssl') OR contains(said, 'certificate')", "TLS_FAILURE", "PROVIDER_FALLBACK", 0.85),
    ("network", "contains(said, 'dns') OR contains(said, 'connect')", "NETWORK_FAILURE", "RETRY", 0.8), ("server", "status >= 500", "SERVER_ERROR", "RETRY", 0.8),
    ("denied_challenge", "status = 403 AND challenged", "SOFT_BLOCK", "BROWSER", 0.9), ("denied_other_type", "status = 403 AND other_type", "ACCESS_DENIED", "STOP", 0.8), ("denied_login", "status = 403 AND login", "ACCESS_DENIED", "STOP", 0.85),
    ("denied_with_page", f"status = 403 AND bare >= {_L['denied_html']}", "SOFT_BLOCK", "BROWSER", 0.7), ("denied", "status = 403", "ACCESS_DENIED", "STOP", 0.8), ("missing", "status = 404", "ACCESS_DENIED", "STOP", 0.85),
    ("robots", "contains(said, 'robots')", "ACCESS_DENIED", "STOP", 0.9), ("other_retryable", "failed AND retryable", "NETWORK_FAILURE", "RETRY", 0.5), ("other_error", "failed", "ACCESS_DENIED", "STOP", 0.5),
    ("other_type", "other_type", "UNSUPPORTED_CONTENT_TYPE", "ACCEPT", 0.8), ("truncated", "truncated AND NOT unextracted", "OUTPUT_TRUNCATED", "CONTINUE_CONTENT", 0.95), ("login_wall", "status < 400 AND login", "AUTH_REQUIRED", "REQUIRE_AUTH", 0.85),
    ("challenge", "status = 200 AND (challenged OR challenged_text)", "CHALLENGE", "BROWSER", 0.95), ("script_placeholder", "status = 200 AND needs_script", "JS_REQUIRED", "BROWSER", 0.85),
    ("low_density", f"status = 200 AND length(content) < {_L['real_text']} AND length(html) > {_L['dense_html']} AND any_script_share > {_L['low_script']}", "LOW_CONTENT_DENSITY", "BROWSER", 0.8),
    ("low_quality", f"status = 200 AND content_quality = 'low' AND length(html) > {_L['quality_html']}", "LOW_QUALITY", "BROWSER", 0.6), ("no_content", "blank", "AMBIGUOUS", "NONE", 0.4),
    ("unextracted_visible", f"unextracted AND visible >= {_L['visible']}", "COMPLETE_SHORT_PAGE", "ACCEPT", 0.8), ("unextracted", "unextracted", "LOW_CONTENT_DENSITY", "BROWSER", 0.7),
    ("thin_shell", f"length(content) < {_L['thin_text']} AND length(raw_html) > {_L['large_html']} AND script_share > {_L['high_script']}", "AMBIGUOUS", "NONE", 0.45),
    ("collapsed", f"length(content) <= {_L['short_text']} AND length(raw_html) >= {_L['collapse_html']} AND length(content) < {_L['collapse_ratio']}::DOUBLE * length(raw_html)", "AMBIGUOUS", "BROWSER", 0.6),
    ("short_page", f"length(content) <= {_L['short_text']}", "COMPLETE_SHORT_PAGE", "ACCEPT", 0.8), ("complete", "true", "COMPLETE_CONTENT", "ACCEPT", 0.85),
)


def _responses(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(RESPONSES)


@query("recovery_decisions", f"""
WITH responses AS ({RESPONSES}), {_FEATURES},
o AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{r}', '{a}', {c}::DOUBLE)" for n, _, r, a, c in _RULES)}) AS v(rule, reason, action, confidence))
SELECT page_id, status::INTEGER AS status, rule, reason, action, confidence, action NOT IN ('ACCEPT', 'STOP', 'NONE') AS recoverable
FROM (SELECT page_id, status, CASE {" ".join(f"WHEN {w} THEN '{n}'" for n, w, *_ in _RULES)} END AS rule FROM f) JOIN o USING (rule)
""")
def recovery_decisions(spark, sf_dir):
    return R.decide(_responses(spark, sf_dir)).select("page_id", "status", "rule", "reason", "action", "confidence", "recoverable")


@query("recovery_coverage", f"""
WITH responses AS ({RESPONSES}), {_FEATURES},
w AS (SELECT CASE {" ".join(f"WHEN {w} THEN '{n}'" for n, w, *_ in _RULES)} END AS first, unnest([{", ".join(f"{{'place': {i + 1}, 'rule': '{n}', 'held': {w}}}" for i, (n, w, *_) in enumerate(_RULES))}]) AS r FROM f)
SELECT r.place AS place, r.rule AS rule, count(*) FILTER (r.held) AS held, count(*) FILTER (first = r.rule) AS decided, count(*) FILTER (r.held AND first <> r.rule) AS overlapped, count(*) FILTER (r.held) > 0 AND count(*) FILTER (first = r.rule) = 0 AS unreachable
FROM w GROUP BY ALL
""")
def recovery_coverage(spark, sf_dir):
    return R.coverage(_responses(spark, sf_dir))

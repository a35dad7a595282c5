"""What to do about a fetched response: rules as data, the first that holds decides.

A rule is a condition over features of the response, a reason and a confidence; reasons carry the action. All
features are columns that are computed once; the rules become one CASE. ``findings`` checks the table itself,
``coverage`` checks it against responses: which rules hold, which decide, and which never do
because an earlier one always holds too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import assessment

# Thresholds, markers, and reasons with their action, usual confidence and whether a browser is called for.
LIMITS = {
    "short_text": 2000, "thin_text": 1500, "large_html": 20_000, "high_script": 0.15, "denied_html": 256, "real_text": 200,
    "dense_html": 3000, "quality_html": 2000, "low_script": 0.2, "collapse_html": 20_000, "collapse_ratio": 0.005, "visible": 50,
}
CHALLENGE = (
    "cloudflare", "attention required", "checking your browser", "just a moment", "captcha", "are you a human", "cf-browser-verification", "challenge-platform", "安全检测", "检测当前网络环境", "火山引擎",
    "prove your humanity", "not for bots", "complete the challenge", "verify you are human", "verify you are a human", "human verification",
)
NEEDS_SCRIPT = ("enable javascript", "javascript is required", "please enable javascript", "you need to enable javascript")
LOGIN = (
    "please log in", "please sign in", "log in to view", "sign in to view", "login required", "sign in required", "must be logged in", "please login", "需要登录", "请登录", "登录后查看", "登录后才能", "请先登录",
    "验证码登录", "登录/注册", "忘记密码", "获取短信验证码", "自动登录", "login / register", "forgot password", "send code",
)
NOT_HTML = ("application/pdf", "application/json", "application/rss", "application/xml", "text/xml", "image/")
REASONS = {
    "LEGAL_OR_GEO_BLOCK": ("STOP", 0.95, False), "AUTH_REQUIRED": ("REQUIRE_AUTH", 0.95, False), "RATE_LIMITED": ("RETRY_LATER", 0.9, False), "TIMEOUT": ("RETRY", 0.85, False),
    "TLS_FAILURE": ("PROVIDER_FALLBACK", 0.85, False), "NETWORK_FAILURE": ("RETRY", 0.8, False), "SERVER_ERROR": ("RETRY", 0.8, False), "SOFT_BLOCK": ("BROWSER", 0.9, True),
    "ACCESS_DENIED": ("STOP", 0.85, False), "UNSUPPORTED_CONTENT_TYPE": ("ACCEPT", 0.8, False), "OUTPUT_TRUNCATED": ("CONTINUE_CONTENT", 0.95, False), "CHALLENGE": ("BROWSER", 0.95, True),
    "JS_REQUIRED": ("BROWSER", 0.85, True), "LOW_CONTENT_DENSITY": ("BROWSER", 0.8, True), "LOW_QUALITY": ("BROWSER", 0.6, True), "AMBIGUOUS": ("NONE", 0.4, False),
    "COMPLETE_SHORT_PAGE": ("ACCEPT", 0.7, False), "COMPLETE_CONTENT": ("ACCEPT", 0.9, False),
}
ACTIONS = ("ACCEPT", "CONTINUE_CONTENT", "BROWSER", "RETRY", "RETRY_LATER", "PROVIDER_FALLBACK", "REQUIRE_AUTH", "STOP", "NONE")
#: Characters that are searched for markers.
HEAD, LOGIN_HEAD = 4096, 48_000
RESPONSE = "status int, error string, error_code string, retryable boolean, content_type string, content string, raw_html string, extracted boolean, extraction_status string, truncated boolean, content_quality string"


@dataclass(frozen=True)
class Rule:
    """When ``holds``, the reason is ``reason``; its confidence and action unless others are given."""

    name: str
    holds: Callable[[Callable[[str], Column]], Column]
    reason: str
    confidence: float | None = None
    action: str | None = None


def _code(*codes: str) -> Callable[[Callable], Column]:
    return lambda c: c("error_code").isin(*codes)


def _denied(c) -> Column:
    return (c("status") == 403) | (c("error_code") == "FETCH_FORBIDDEN")


def _low(c) -> Column:
    return (c("status") == 200) & (F.length(c("content")) < LIMITS["real_text"]) & (F.length(c("html")) > LIMITS["dense_html"]) & (c("any_script_share") > LIMITS["low_script"])


def _short(c) -> Column:
    return F.length(c("content")) <= LIMITS["short_text"]


#: By priority: protocol, transport, denial, other content, truncation and login walls, browser signals, completeness.
RULES = (
    Rule("legal", lambda c: c("status") == 451, "LEGAL_OR_GEO_BLOCK"),
    Rule("unauthorised", lambda c: c("status").isin(401, 407), "AUTH_REQUIRED"),
    Rule("too_many", lambda c: (c("status") == 429) | _code("FETCH_RATE_LIMITED")(c), "RATE_LIMITED"),
    Rule("accepted_usable", lambda c: (c("status") == 202) & (c("grade") == "usable"), "COMPLETE_CONTENT", 0.8),
    Rule("accepted_unusable", lambda c: c("status") == 202, "SOFT_BLOCK", 0.85),
    Rule("timeout", lambda c: _code("FETCH_TIMEOUT")(c) | c("said").contains("timeout") | c("status").isin(408, 504), "TIMEOUT"),
    Rule("tls", lambda c: _code("FETCH_SSL_ERROR")(c) | c("said").contains("ssl") | c("said").contains("certificate"), "TLS_FAILURE"),
    Rule("network", lambda c: _code("FETCH_DNS_ERROR", "FETCH_CONNECTION_ERROR")(c) | c("said").contains("dns") | c("said").contains("connect"), "NETWORK_FAILURE"),
    Rule("server", lambda c: (c("status") >= 500) | _code("FETCH_SERVER_ERROR")(c), "SERVER_ERROR"),
    Rule("denied_challenge", lambda c: _denied(c) & c("challenged"), "SOFT_BLOCK"),
    Rule("denied_other_type", lambda c: _denied(c) & c("other_type"), "ACCESS_DENIED", 0.8),
    Rule("denied_login", lambda c: _denied(c) & c("login"), "ACCESS_DENIED"),
    Rule("denied_with_page", lambda c: _denied(c) & (F.length(c("html_bare")) >= LIMITS["denied_html"]), "SOFT_BLOCK", 0.7),
    Rule("denied", _denied, "ACCESS_DENIED", 0.8),
    Rule("missing", lambda c: (c("status") == 404) | _code("FETCH_NOT_FOUND")(c), "ACCESS_DENIED"),
    Rule("robots", lambda c: _code("FETCH_ROBOTS_DENIED")(c) | c("said").contains("robots"), "ACCESS_DENIED", 0.9),
    Rule("other_retryable", lambda c: c("failed") & c("retryable"), "NETWORK_FAILURE", 0.5),
    Rule("other_error", lambda c: c("failed"), "ACCESS_DENIED", 0.5),
    Rule("other_type", lambda c: c("other_type"), "UNSUPPORTED_CONTENT_TYPE"),
    Rule("truncated", lambda c: c("truncated") & ~c("unextracted"), "OUTPUT_TRUNCATED"),
    Rule("login_wall", lambda c: (c("status") < 400) & c("login"), "AUTH_REQUIRED", 0.85),
    Rule("challenge", lambda c: (c("status") == 200) & (c("challenged") | c("challenged_text")), "CHALLENGE"),
    Rule("script_placeholder", lambda c: (c("status") == 200) & c("needs_script"), "JS_REQUIRED"),
    Rule("low_density", _low, "LOW_CONTENT_DENSITY"),
    Rule("low_quality", lambda c: (c("status") == 200) & (c("content_quality") == "low") & (F.length(c("html")) > LIMITS["quality_html"]), "LOW_QUALITY"),
    Rule("no_content", lambda c: c("blank"), "AMBIGUOUS"),
    Rule("unextracted_visible", lambda c: c("unextracted") & (c("visible") >= LIMITS["visible"]), "COMPLETE_SHORT_PAGE", 0.8),
    Rule("unextracted", lambda c: c("unextracted"), "LOW_CONTENT_DENSITY", 0.7),
    Rule("thin_shell", lambda c: _short(c) & (F.length(c("content")) < LIMITS["thin_text"]) & (F.length(c("raw_html")) > LIMITS["large_html"]) & (c("script_share") > LIMITS["high_script"]), "AMBIGUOUS", 0.45),
    Rule("collapsed", lambda c: _short(c) & (F.length(c("raw_html")) >= LIMITS["collapse_html"]) & (F.length(c("content")) / F.length(c("raw_html")) < LIMITS["collapse_ratio"]), "AMBIGUOUS", 0.6, "BROWSER"),
    Rule("short_page", _short, "COMPLETE_SHORT_PAGE", 0.8),
    Rule("complete", lambda c: F.lit(True), "COMPLETE_CONTENT", 0.85),
)


def _holds_any(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text holds one of the markers: one regular expression instead of a search for each."""
    return text.rlike("|".join(rf"\Q{m}\E" for m in markers))


def _script_share(html: Column) -> Column:
    code = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script\b[^>]*>"), F.lit(0))
    return F.when(html == "", 0.0).otherwise(F.aggregate(code, F.lit(0), lambda n, x: n + F.length(x)) / F.length(html))


def features(responses: DataFrame) -> DataFrame:
    """Responses (RESPONSE and any other columns but these) with the features that rules ask for; nulls count as empty, false or status 0."""
    filled = {"status": F.coalesce("status", F.lit(0))} | {c: F.coalesce(c, F.lit("")) for c in ("error_code", "content_type", "content", "raw_html", "content_quality")}
    filled |= {c: F.coalesce(c, F.lit(False)) for c in ("retryable", "extracted", "truncated")}
    r = responses.withColumns({"failed": F.col("error").isNotNull(), "said": F.lower(F.coalesce("error", F.lit("")))} | filled)
    r = r.withColumns({"html": F.when(F.col("raw_html") != "", F.col("raw_html")).otherwise(F.col("content")), "type": F.lower("content_type")})
    markup = F.lower(F.substring("content", 1, 2000)).rlike("<html|<!doctype")
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " "), r"\s+", " ")
    return r.withColumns({
        "html_bare": F.regexp_replace("html", r"^\s+|\s+$", ""), "blank": ~F.col("content").rlike(r"\S"), "other_type": F.col("type").rlike("^(" + "|".join(NOT_HTML) + ")"),
        "challenged": _holds_any(F.lower(F.substring("html", 1, HEAD)), CHALLENGE), "challenged_text": _holds_any(F.lower(F.substring("content", 1, HEAD)), CHALLENGE),
        "needs_script": _holds_any(F.lower(F.substring("html", 1, HEAD)), NEEDS_SCRIPT), "login": _holds_any(F.lower(F.substring("html", 1, LOGIN_HEAD)), LOGIN),
        "grade": F.when(F.col("status") == 202, assessment(F.col("content"))["grade"]), "script_share": _script_share(F.col("raw_html")), "any_script_share": _script_share(F.col("html")),
        "unextracted": F.col("type").contains("html") & ~F.col("extracted") & markup & F.coalesce(F.col("extraction_status") != "unavailable", F.lit(True)),
        "visible": F.length(F.trim(shown)),
    })


def _case(conditions: list[Column], values: list) -> Column:
    found = F.when(conditions[0], values[0])
    for c, v in zip(conditions[1:], values[1:]):
        found = found.when(c, v)
    return found


def decide(responses: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``responses`` with rule, reason, action, confidence and recoverable of the first rule that holds (nulls if none does)."""
    holds = [F.coalesce(r.holds(F.col), F.lit(False)) for r in rules]
    told = features(responses).withColumn("rule", _case(holds, [r.name for r in rules]))
    # a rule's outcome is looked up by its name, so conditions are evaluated once
    outcome = {r.name: (r.reason, r.action or REASONS[r.reason][0], REASONS[r.reason][1] if r.confidence is None else r.confidence) for r in rules}
    named = [F.col("rule") == n for n in outcome]
    told = told.withColumns({k: _case(named, [o[i] for o in outcome.values()]) for i, k in enumerate(("reason", "action", "confidence"))})
    return told.select(*responses.columns, "rule", "reason", "action", "confidence", (~F.col("action").isin("ACCEPT", "STOP", "NONE")).alias("recoverable"))


def coverage(responses: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule: place, held and decided (responses), overlapped (held, but an earlier rule decided), unreachable (held somewhere, decided nowhere).

    One pass with partial counts; the output has a row per rule.
    """
    held = features(responses).select(*[F.coalesce(r.holds(F.col), F.lit(False)).alias(r.name) for r in rules])
    names = [r.name for r in rules]
    first = held.withColumn("rule", _case([F.col(n) for n in names], names))
    sums = [F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias("rule"), F.count_if(F.col(n)).alias("held"), F.count_if(F.col("rule") == n).alias("decided")) for i, n in enumerate(names)]
    rows = first.agg(F.array(*sums).alias("r")).select(F.inline("r"))
    return rows.select("*", (F.col("held") - F.col("decided")).alias("overlapped"), ((F.col("held") > 0) & (F.col("decided") == 0)).alias("unreachable"))


def findings(rules: tuple[Rule, ...] = RULES, reasons: dict = REASONS) -> list[str]:
    """What is wrong with the tables themselves: unknown reasons and actions, reasons without a rule, browser reasons that call no browser, repeated names."""
    found = [f"{r.name}: unknown reason {r.reason}" for r in rules if r.reason not in reasons]
    found += [f"{r.name}: unknown action {r.action}" for r in rules if r.action and r.action not in ACTIONS]
    found += [f"{k}: unknown action {a}" for k, (a, _, _) in reasons.items() if a not in ACTIONS]
    found += [f"{k}: calls for a browser but its action is {a}" for k, (a, _, browser) in reasons.items() if browser and a != "BROWSER"]
    found += [f"{k}: no rule gives this reason" for k in reasons if k not in {r.reason for r in rules}]
    names = [r.name for r in rules]
    return found + [f"{n}: name given twice" for n in sorted({n for n in names if names.count(n) > 1})]

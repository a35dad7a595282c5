"""What pages say about themselves. ``pages`` has bare heads, so each page first gets one that its id and URL determine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import metadata as M
from millrace.functions.nodes import Rule, extract_all, page_nodes
from millrace.functions.schema import by_schema
from millrace.plans.registry import query, table

#: Pages with heads of five kinds, in words that both engines understand: none; named tags; cards; one JSON-LD object and a broken one; graphs, lists and repeated tags.
HEADED = """
SELECT page_id, url, replace(html, '<title>', CASE page_id % 5
  WHEN 1 THEN '<META content="About page ' || page_id || ' &amp; more" NAME=Description><meta name="keywords" content="one, two ,,p' || page_id || '"><meta name="author" content="A. Writer"><link rel="shortcut icon" href="/i/' || page_id || '.png"><!-- <meta name="author" content="nobody"> -->'
  WHEN 2 THEN '<meta property="og:title" content="Card ' || page_id || '"><meta property="og:image" content="img/' || page_id || '.jpg"><meta name=' || chr(39) || 'twitter:title' || chr(39) || ' content=' || chr(39) || 'Bird ' || page_id || chr(39) || '><meta name="twitter:image" content="//cdn.example.net/b.png"><link href="/canon/' || page_id || '" rel="canonical nofollow">'
  WHEN 3 THEN '<script type="application/ld+json">{"@type": "Article", "n": ' || page_id || '}</script><script type="application/ld+json">{"@type": "Broken"</script><meta name="description" content="">'
  WHEN 4 THEN '<script type="application/ld+json"> [{"@context": "x", "@type": "Site", "@graph": [{"@type": "Page"}, [{"@type": "Deep", "@graph": [{"@type": "Deeper"}]}], "text"]}, {"@type": "Last"}, 7] </script><meta name="author" content="first"><meta name="author" content="second ' || page_id || '"><meta property="article:tag" content="t1"><meta name="article:tag" content="t' || page_id || '"><meta property="article:section" content="News">'
  ELSE '' END || '<title>') AS html FROM pages
"""

_PAIRS = r"""list_transform(regexp_extract_all({0}, '[^\s"''<>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), lambda a: {{'k': lower(regexp_extract(a, '^[^\s=]+')), 'v': {1}}})"""
_TAGS = r"""regexp_extract_all({0}, '(?is)<{1}\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')"""


def _decoded(x: str) -> str:
    for name, sign in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&#x2F;", "'/'")):
        x = f"replace({x}, '{name}', {sign})"
    return x


def _pairs(x: str) -> str:
    return _PAIRS.format(x, _decoded(r"""regexp_replace(regexp_replace(a, '^[^=]*=\s*', ''), '(?s)^["''](.*)["'']$', '\1')"""))


def _tags(x: str, name: str) -> str:
    return _TAGS.format(x, name)


def _value(pairs: str, name: str) -> str:
    return f"coalesce(list_filter({pairs}, lambda p: p.k = '{name}')[1].v, '')"


def _resolved(x: str) -> str:
    return rf"""CASE WHEN {x} = '' OR regexp_matches({x}, '^(https?://|data:)|^[A-Za-z][A-Za-z0-9+.-]*:') THEN {x} WHEN {x} LIKE '//%' THEN regexp_extract(url, '^([A-Za-z]+):', 1) || ':' || {x}
      WHEN {x} LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || {x} ELSE rtrim(regexp_extract(url, '^([A-Za-z]+://[^/?#]+(?:/[^?#]*/)?)', 1), '/') || '/' || {x} END"""


def _last(part: str, key: str) -> str:
    return f"coalesce(list_filter(found, lambda m: m.{part} = '{key}')[-1].content, '')"


@query("page_metadata", rf"""
WITH RECURSIVE headed AS ({HEADED}),
p0 AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS page FROM headed),
p1 AS (SELECT *, regexp_replace(page, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS bare FROM p0),
p2 AS (SELECT *, list_transform(list_transform({_tags("bare", "meta")}, lambda t: {_pairs("t")}), lambda q: {{'name': lower({_value("q", "name")}), 'property': lower({_value("q", "property")}), 'content': trim({_value("q", "content")}), 'charset': {_value("q", "charset")}}}) AS found,
    list_transform({_tags("bare", "link")}, lambda t: {_pairs("t")}) AS heads FROM p1),
s AS (SELECT page_id, unnest(regexp_extract_all(page, '(?is)<script\b[^>]*\btype\s*=\s*["'']?application/ld\+json["'']?[^>]*>(.*?)</script\s*>', 1)) AS t, generate_subscripts(regexp_extract_all(page, '(?is)<script\b[^>]*\btype\s*=\s*["'']?application/ld\+json["'']?[^>]*>(.*?)</script\s*>', 1), 1) AS i FROM p1),
n AS (
  SELECT page_id, [i] AS place, 0 AS depth, t::JSON AS v FROM s WHERE json_valid(t)
  UNION ALL
  SELECT page_id, list_append(place, i), depth + 1, json_extract(kids, '$[' || (i - 1) || ']')
  FROM (SELECT page_id, place, depth, kids, unnest(range(1, json_array_length(kids)::BIGINT + 1)) AS i
    FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN v WHEN json_type(v, '$."@graph"') = 'ARRAY' THEN v->'$."@graph"' END AS kids FROM n WHERE depth < 3) WHERE kids IS NOT NULL)
),
j AS (SELECT page_id, count(*) AS nodes, string_agg(coalesce(v->>'$."@type"', ''), ',' ORDER BY place) AS types FROM n WHERE json_type(v) = 'OBJECT' GROUP BY page_id),
r AS (
  SELECT page_id, trim({_decoded("regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title', 1)")}) AS title,
    {_value(f"(list_transform({_tags('bare', 'html')}, lambda t: {_pairs('t')}))[1]", "lang")} AS language,
    coalesce(list_filter(found, lambda m: m.charset <> '')[1].charset, '') AS charset,
    {_last("name", "description")} AS description, {_last("name", "author")} AS author,
    list_filter(list_transform(string_split({_last("name", "keywords")}, ','), lambda k: trim(k)), lambda k: k <> '') AS keywords,
    {_last("property", "og:title")} AS og_title, {_last("name", "twitter:title")} AS twitter_title, {_last("property", "og:image")} AS og0, {_last("name", "twitter:image")} AS tw0,
    coalesce({_value("(list_filter(heads, lambda q: list_contains(string_split(" + _value("q", "rel") + ", ' '), 'canonical')))[1]", "href")}, '') AS canon0,
    coalesce({_value("(list_filter(heads, lambda q: contains(lower(" + _value("q", "rel") + "), 'icon')))[1]", "href")}, '') AS icon0,
    list_transform(list_filter(found, lambda m: CASE WHEN m.name LIKE 'article:%' THEN m.name ELSE m.property END = 'article:tag'), lambda m: m.content) AS article_tags,
    coalesce(list_filter(found, lambda m: CASE WHEN m.name LIKE 'article:%' THEN m.name ELSE m.property END = 'article:section')[-1].content, '') AS article_section,
    len(list_distinct(list_transform(list_filter(found, lambda m: m.content <> '' AND (m.name <> '' OR m.property <> '')), lambda m: CASE WHEN m.name <> '' THEN m.name ELSE m.property END)))::INTEGER AS raw_meta,
    list_filter(list_transform({_tags("bare", "a")}, lambda t: {_value(_pairs("t"), "href")}), lambda h: h <> '' AND NOT regexp_matches(h, '^(#|javascript:|mailto:|tel:)'))[:200] AS hrefs, url
  FROM p2
)
SELECT page_id, title, language, charset, description, author, array_to_string(keywords, '|') AS keywords, og_title, {_resolved("og0")} AS og_image, {_resolved("tw0")} AS twitter_image,
  {_resolved("canon0")} AS canonical_url, {_resolved("icon0")} AS favicon, array_to_string(article_tags, '|') AS article_tags, article_section, raw_meta, coalesce(nodes, 0)::INTEGER AS nodes, coalesce(types, '') AS types,
  len(hrefs)::INTEGER AS links, CASE WHEN len(hrefs) > 0 THEN {_resolved("hrefs[1]")} ELSE '' END AS first_link,
  CASE WHEN og_title <> '' THEN og_title WHEN twitter_title <> '' THEN twitter_title ELSE title END AS best_title,
  CASE WHEN og0 <> '' THEN {_resolved("og0")} ELSE {_resolved("tw0")} END AS best_image
FROM r LEFT JOIN j USING (page_id)
""")
def page_metadata(spark, sf_dir):
    """The record of every page, with the head that its id gives it."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    m = spark.sql(HEADED).select("page_id", M.page_metadata(F.col("html"), F.col("url")).alias("m"))
    own = ("title", "language", "charset", "description", "author", "og_title", "og_image", "twitter_image", "canonical_url", "favicon", "article_section")
    return m.select(
        "page_id", *[f"m.{c}" for c in own], F.array_join("m.keywords", "|").alias("keywords"), F.array_join("m.article_tags", "|").alias("article_tags"),
        F.size("m.raw_meta").alias("raw_meta"), F.size("m.json_ld").alias("nodes"),
        F.array_join(F.transform("m.json_ld", lambda v: F.coalesce(F.try_variant_get(v, '$["@type"]', "string"), F.lit(""))), ",").alias("types"),
        F.size("m.links").alias("links"), F.coalesce(F.get(F.col("m.links"), F.lit(0))["href"], F.lit("")).alias("first_link"),
        M.best(F.col("m"), "title").alias("best_title"), M.best(F.col("m"), "image").alias("best_image"),
    )


RULES = [
    Rule("heading", "article h1, main h1, h1"), Rule("menu", "nav a", multiple=True), Rule("targets", "nav > ul > li a[href^='/']", attribute="href", multiple=True),
    Rule("language", "html", attribute="lang", default="none"), Rule("first_word", "article p", pattern=r"^(\w+)"), Rule("notices", "div.ad, .cookie-notice, aside", multiple=True),
    Rule("charset", "meta[charset]", attribute="charset"), Rule("footer", "footer", default=""), Rule("capitals", "p", pattern="[A-Z]{2,}", multiple=True),
]


@query("page_rules")
def page_rules(spark, sf_dir):
    """Values of every page by selectors, attributes and patterns."""
    nodes = table(spark, sf_dir, "pages").select("page_id", page_nodes("html").alias("nodes"))
    return nodes.select("page_id", F.size("nodes").alias("n_nodes"), *extract_all(F.col("nodes"), RULES))


SCHEMA = {"properties": {"title": {"type": "string"}, "description": {}, "author": {}, "keywords": {}, "image": {}, "date": {}, "n": {"type": "integer"}, "missing": {}}}


@query("schema_fields")
def schema_fields(spark, sf_dir):
    """Eight fields of every page, with the head that its id gives it, and where they came from."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    f = by_schema(spark.sql(HEADED), SCHEMA)
    names = list(SCHEMA["properties"])
    return f.select("page_id", *[F.col("data")[n].alias(n) for n in names], *[F.col("sources")[n].alias(f"{n}_source") for n in names], F.size("missing").alias("n_missing"))

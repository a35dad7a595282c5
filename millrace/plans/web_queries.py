"""Queries over ``pages`` and sensitive data in ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import web as U
from millrace.plans.registry import query, table

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query("page_text", r"""
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM pages)
""")
def page_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", U.page_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("seo_regex", rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, html, lower(html) AS low,
  list_filter(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*)["'']', 1), lambda h: NOT regexp_matches(h, '^(#|mailto:|tel:|javascript:)')) AS links, regexp_extract_all(html, '(?i)<img[^>]*>') AS images FROM pages)
SELECT page_id, length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title_length,
  length(trim(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)["'']', 1))) AS meta_description_length,
  len(regexp_extract_all(html, '(?i)<h[12][\s>]')) AS heading_count, len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS h1_count, len(images) AS image_count,
  len(list_filter(images, lambda i: regexp_matches(i, '(?i)\balt=["''][^"'']+'))) AS images_with_alt,
  len(list_filter(links, lambda h: NOT regexp_matches(h, '^(https?:)?//') OR (host <> '' AND contains(h, host)))) AS internal_links,
  len(list_filter(links, lambda h: regexp_matches(h, '^(https?:)?//') AND NOT (host <> '' AND contains(h, host)))) AS external_links,
  contains(low, 'application/ld+json') OR contains(low, 'itemtype') AS has_schema, regexp_matches(low, 'property=["'']og:') AS has_og_tags, regexp_matches(low, 'name=["'']twitter:') AS has_twitter_cards,
  regexp_extract(html, '(?is)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1) AS canonical_url
FROM p
""")
def seo_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in U.seo(F.col("html"), F.col("url")).items()])


@query("page_perf", r"""
WITH c AS (SELECT page_id, octet_length(encode(html)) AS bytes, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS nodes, len(regexp_extract_all(html, '(?i)<script[^>]+src=')) AS scripts,
  len(regexp_extract_all(html, '(?i)<link[^>]+rel=["'']stylesheet')) AS styles, len(regexp_extract_all(html, '(?i)<img[\s>]')) AS images, len(regexp_extract_all(html, '(?i)<iframe[\s>]')) AS iframes, regexp_matches(html, 'loading=["'']lazy["'']') AS lazy FROM pages)
SELECT page_id, bytes, nodes, scripts + styles + images + iframes AS requests, lazy, CASE WHEN bytes < 50000 THEN 100 WHEN bytes < 100000 THEN 80 WHEN bytes < 200000 THEN 60 ELSE 40 END AS size_score FROM c
""")
def page_perf(spark, sf_dir):
    h = F.col("html")
    bytes_ = F.octet_length("html")
    requests = U.counted(h, r"(?i)<script[^>]+src=") + U.counted(h, r"(?i)<link[^>]+rel=[\"']stylesheet") + U.counted(h, r"(?i)<img[\s>]") + U.counted(h, r"(?i)<iframe[\s>]")
    score = F.when(bytes_ < 50_000, 100).when(bytes_ < 100_000, 80).when(bytes_ < 200_000, 60).otherwise(40)
    return table(spark, sf_dir, "pages").select("page_id", bytes_.alias("bytes"), U.counted(h, "<[a-zA-Z][^>]*>").alias("nodes"), requests.alias("requests"), h.rlike("loading=[\"']lazy[\"']").alias("lazy"), score.alias("size_score"))


@query("url_hosts", f"SELECT {_HOST} AS host, count(*) AS pages, count(*) FILTER (WHERE url LIKE 'https://%') AS secure FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("url").startswith("https://")).alias("secure"))


_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)


@query("canonical_urls", rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS authority,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK})), '&') AS q FROM pages)
SELECT page_id, CASE WHEN authority = '' THEN '' ELSE scheme || '://' || authority || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key FROM p
""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.identity_key(F.col("url")).alias("key"))


@query("domain_diversity", f"SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS place FROM pages QUALIFY place <= 2")
def domain_diversity(spark, sf_dir):
    """At most two pages a host; Spark cuts the groups before the shuffle."""
    p = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("place <= 2")


@query("links", r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([A-Za-z]+):', 1) || ':' || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href ELSE rtrim(regexp_extract(url, '^([A-Za-z]+://[^/?#]+(?:/[^?#]*/)?)', 1), '/') || '/' || href END AS target,
  CASE WHEN lower(href) LIKE 'https:%' THEN 'https' WHEN lower(href) LIKE 'http:%' THEN 'http' WHEN lower(href) LIKE 'mailto:%' THEN 'mail' WHEN lower(href) LIKE 'tel:%' THEN 'phone' WHEN href LIKE '#%' THEN 'fragment' ELSE 'relative' END AS kind
FROM l
""")
def links(spark, sf_dir):
    l = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(U.links(F.col("html"))).alias("href"))
    return l.select("page_id", "href", U.absolute(F.col("url"), F.col("href")).alias("target"), U.link_kind(F.col("href")).alias("kind"))


_P = {k: p.replace("'", "''") for k, (p, _) in U.SENSITIVE.items()}


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {k}" for k, p in _P.items()) + " FROM documents")
def pii_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in U.sensitive_counts(F.col("text")).items()])


def _mask_sql() -> str:
    out = "coalesce(text, '')"
    for pattern, stars, grouped in U.mask_steps():
        to = rf"\1{'*' * stars}\2" if grouped else "*" * stars
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return out


@query("pii_mask", f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {_mask_sql()} AS t FROM documents)")
def pii_mask(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", U.masked(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


#: Scheme, host, path and parameters of ``url`` as search results are compared by them.
RESULT_KEY = r"""(SELECT lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1))
  || rtrim(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/')
  || CASE WHEN c <> '' THEN '?' || c ELSE '' END
 FROM (SELECT u, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(g, lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))), lambda k: lower(k) NOT IN ({tracking})))),
     lambda k: k || '=' || list_filter(list_transform(g, lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))]), lambda x: x[1] = k)[1][2]), '&'), '') AS c
   FROM (SELECT u, list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')) AS g FROM (SELECT coalesce(url, '') AS u))))""".replace("{tracking}", ", ".join(f"'{t}'" for t in U.RESULT_TRACKING))


@query("result_keys", f"SELECT page_id, {RESULT_KEY} AS key FROM pages")
def result_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.result_key(F.col("url")).alias("key"))


@query("request_urls", r"""
WITH p AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages),
q AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), ''), 'https') AS scheme,
             lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS authority,
             regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+', '/', 'g') AS path,
             regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM p)
SELECT page_id, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(authority, ':80$', '') WHEN 'https' THEN regexp_replace(authority, ':443$', '') ELSE authority END
  || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS request
FROM q
""")
def request_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.request_url(F.col("url")).alias("request"))


@query("sponsored", "SELECT page_id, " + " OR ".join(f"contains(lower(coalesce(url, '')), '{m}')" for m in U.AD_MARKERS) + " AS sponsored FROM pages")
def sponsored(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.sponsored(F.col("url")).alias("sponsored"))

"""URL filters by a temporal list join.

A list's dated entries (value, action, day) become validity intervals: an "add" holds until the
value's next entry. A value is a host with all its subdomains, or a host with a path prefix. Every capture is
looked up under each host suffix and path prefix it has, and the as-of join takes for each the
interval in force on the day of fetching. Only keys and days are shuffled. Which intervals hold on a
day is found once for all captures of a key and day; the captures of a key and day with a third of all
rows meet their one interval in a join whose hot side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
#: Hosts that are addresses have no parent domains.
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+)*)$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without credentials, port and final dot, an IPv6 address in its brackets; null if there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def entry_key(value: Column) -> Column:
    """What a list entry stands for: its host, and its path's segments if it has any; null without a host.

    Scheme, credentials, port, final dot, query and fragment do not count, nor do slashes that end the path or stand
    double. Hosts are in lower case; paths tell cases apart.
    """
    url = F.when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), value).otherwise(F.concat(F.lit("any://"), F.regexp_replace(value, "^//", "")))
    parts = segments(F.regexp_extract(url, PATH, 1))
    return F.when(F.size(parts) > 0, F.concat(host_of(url), F.lit("/"), F.array_join(parts, "/"))).otherwise(host_of(url))


def void_entries(entries: DataFrame) -> DataFrame:
    """The entries that can match nothing: without a host or a day."""
    return entries.where(entry_key(F.trim("value")).isNull() | F.col("day").isNull())


def intervals(entries: DataFrame) -> DataFrame:
    """value, since, until (null: still in force). Of a value's entries on one day the last by action stands, a removal over an addition."""
    keyed = entries.select(entry_key(F.trim("value")).alias("value"), "day", "action").where("value is not null and day is not null")
    daily = keyed.groupBy("value", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("value").orderBy("day"))
    return daily.withColumn("until", following).where("action = 'add'").select("value", F.col("day").alias("since"), "until")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys_of(host: Column, path: Column, depths: Column) -> Column:
    """Values that a capture is looked up under: host suffixes of two labels or more, and host with as many first path segments as ``depths`` names.

    ``depths`` are the numbers of segments that the list's entries have, so every prefix that can match is looked up, however deep.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    suffixes = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(domains)
    parts = segments(path)
    fitting = F.filter(depths, lambda d: d <= F.size(parts))
    prefixes = F.transform(fitting, lambda d: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")))
    return F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>"))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per distinct capture (page_id, url, day): with host, blocked, matched (the longest value in force, ties by value) and listed_since.

    A capture without an absolute URL or a day matches nothing and is not blocked. URLs of any length and depth are looked up
    whole. Repeated captures count once; entries without a host or a day are void (``void_entries`` lists them); without entries nothing is blocked; no captures give no rows; other
    columns are ignored.
    """
    rows = captures.select("page_id", "url", "day").distinct().withColumn("host", host_of(F.col("url")))
    spans = intervals(entries)
    depths = spans.select((F.size(F.split("value", "/")) - 1).alias("depth")).where("depth > 0").agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    looked = rows.crossJoin(F.broadcast(depths)).where("host is not null and day is not null").select("page_id", "url", "day", F.explode(keys_of(F.col("host"), F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")), F.col("depths"))).alias("value"))
    asked = looked.select("value", "day").distinct()
    held = asked.join(spans, "value").where("since <= day and (until is null or day < until)")
    best = F.max(F.struct(F.length("value").alias("length"), "value", "since"))
    hits = looked.join(held, ["value", "day"]).groupBy("page_id", "url", "day").agg(best.alias("best"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("page_id", "url", "day")]
    return rows.alias("r").join(hits.alias("h"), same, "left").select(
        "r.page_id", "r.url", "r.day", "r.host", F.col("h.best").isNotNull().alias("blocked"), F.col("h.best.value").alias("matched"), F.col("h.best.since").alias("listed_since")
    )


def _number(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), at, 6), 16, 10).cast("long")


def dated(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, which bear no dates: each is given one of 730 days by its page_id."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).alias("day"))


def example_list(pages: DataFrame) -> DataFrame:
    """A dated list from ``pages``: hosts, their registered domains, and hosts with one or two path segments.

    A quarter of these values is added, later removed, and every other of them added again. They are written in the
    forms that lists use: plain, with a slash at the end, a scheme, a port, a final dot, or doubled slashes and a query.
    """
    url = F.col("url").cast("string")
    named = pages.select(host_of(url).alias("host"), segments(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))).alias("parts")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    domain = F.when((F.size(labels) > 2) & ~F.col("host").rlike(ADDRESS), F.array_join(F.slice(labels, F.size(labels) - 1, F.lit(2)), "."))
    prefix = lambda n: F.when(F.size("parts") >= n, F.concat("host", F.lit("/"), F.array_join(F.slice("parts", 1, n), "/")))
    hosts = named.select(F.explode(F.array("host", domain, prefix(1), prefix(2))).alias("value")).where("value is not null").distinct()
    listed = hosts.where(F.pmod(_number(F.col("value"), 1), F.lit(4)) == 0).withColumn("start", F.pmod(_number(F.col("value"), 7), F.lit(400)).cast("int")).withColumn("length", (F.pmod(_number(F.col("value"), 13), F.lit(200)) + 30).cast("int"))
    first = F.lit("2023-01-01").cast("date")
    entry = lambda action, after: F.struct(F.lit(action).alias("action"), F.date_add(first, after).alias("day"))
    again = F.pmod(_number(F.col("value"), 19), F.lit(2)) == 0
    entries = F.array(entry("add", F.col("start")), entry("remove", F.col("start") + F.col("length")), F.when(again, entry("add", F.col("start") + F.col("length") + 60)))
    host, rest = F.regexp_extract("value", "^[^/]*", 0), F.regexp_extract("value", "(?s)/.*", 0)
    forms = [F.col("value"), F.concat("value", F.lit("/")), F.concat(F.lit("http://"), "value"), F.concat(host, F.lit(":8080"), rest), F.concat(host, F.lit("."), rest), F.concat(host, F.replace(rest, F.lit("/"), F.lit("//")), F.lit("?a=1"))]
    written = F.element_at(F.array(*forms), (F.pmod(_number(F.col("value"), 25), F.lit(len(forms))) + 1).cast("int"))
    return listed.select(written.alias("value"), F.inline(F.filter(entries, lambda e: e.isNotNull())))


def filter_pages(pages: DataFrame) -> DataFrame:
    """``evaluate`` over ``pages`` with the days as text."""
    out = evaluate(dated(pages), example_list(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("day", "listed_since")})


ORACLE = """
WITH captures AS (
  SELECT DISTINCT page_id, url, DATE '2023-01-01' + ((page_id * 37) % 730)::INTEGER AS day,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '.'), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages),
labelled AS (
  SELECT *, string_split(host, '.') AS labels, regexp_matches(host, '^(\\[.*|[0-9]+(\\.[0-9]+)*)$') AS address
  FROM captures WHERE host IS NOT NULL),
hosts AS (
  SELECT DISTINCT value, md5(value) AS h
  FROM (SELECT unnest([host, CASE WHEN len(labels) > 2 AND NOT address THEN array_to_string(labels[-2:], '.') END,
                       CASE WHEN len(parts) >= 1 THEN host || '/' || parts[1] END,
                       CASE WHEN len(parts) >= 2 THEN host || '/' || parts[1] || '/' || parts[2] END]) AS value
        FROM labelled)
  WHERE value IS NOT NULL),
listed AS (
  SELECT value, (('0x' || h[7:12])::BIGINT % 400)::INTEGER AS start, (('0x' || h[13:18])::BIGINT % 200 + 30)::INTEGER AS length,
         ('0x' || h[19:24])::BIGINT % 2 = 0 AS again
  FROM hosts WHERE ('0x' || h[1:6])::BIGINT % 4 = 0),
spans AS (
  SELECT value, DATE '2023-01-01' + start AS since, DATE '2023-01-01' + start + length AS until FROM listed
  UNION ALL
  SELECT value, DATE '2023-01-01' + start + length + 60, NULL FROM listed WHERE again),
looked AS (
  SELECT page_id, url, day, unnest(list_concat(
           CASE WHEN address THEN [host] ELSE [array_to_string(labels[i:], '.') FOR i IN range(1, greatest(len(labels), 2))] END,
           [host || '/' || array_to_string(parts[:d], '/') FOR d IN range(1, least(len(parts), 2) + 1)])) AS value
  FROM labelled),
hits AS (
  SELECT page_id, url, day, max({'length': length(value), 'value': value, 'since': since}) AS best
  FROM looked JOIN spans USING (value)
  WHERE since <= day AND (until IS NULL OR day < until)
  GROUP BY page_id, url, day)
SELECT c.page_id, c.url, c.day::VARCHAR AS day, c.host, h.best IS NOT NULL AS blocked, h.best.value AS matched, h.best.since::VARCHAR AS listed_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url AND c.day = h.day
"""

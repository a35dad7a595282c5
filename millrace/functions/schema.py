"""Fields of a page by name: from its structured data, its meta tags, or its markup, each with where it came from."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import metadata as M
from millrace.functions import nodes as N
from millrace.functions.passages import let, strip

# Names under which structured data, meta tags and class names hold a field.
DATA_NAMES = {
    "title": "name headline", "name": "name headline", "description": "description abstract", "price": "price lowPrice highPrice", "currency": "priceCurrency", "author": "author creator", "date": "datePublished dateCreated uploadDate",
    "published": "datePublished dateCreated uploadDate", "modified": "dateModified", "keywords": "keywords", "image": "image thumbnailUrl", "url": "url @id", "rating": "ratingValue reviewRating", "brand": "brand manufacturer",
}
META_NAMES = {
    "title": "og:title twitter:title", "name": "og:title twitter:title", "description": "og:description twitter:description description", "image": "og:image twitter:image", "url": "og:url", "date": "article:published_time article:modified_time",
    "published": "article:published_time og:article:published_time", "modified": "article:modified_time og:updated_time og:article:modified_time", "keywords": "keywords article:tag", "author": "article:author twitter:creator", "site_name": "og:site_name",
}
CLASS_NAMES = {"price": "price cost amount money", "author": "author byline writer", "date": "date time published posted", "title": "title headline heading", "description": "description summary excerpt intro", "rating": "rating stars score"}
TITLES, DATES, SUMMARIES = ("title", "name", "headline"), ("date", "published", "datepublished"), ("description", "summary", "excerpt")
#: Fields of a page's record that answer to their own name.
DIRECT = ("title", "description", "author", "language", "canonical_url", "favicon", "robots", "og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name", "viewport", "charset", "generator", "theme_color")
LONGEST, LONGEST_HINT = 400, 300
DEEPEST = 50


def _flat(texts: list[str]) -> dict[str, str]:
    """Scalars of JSON-LD texts by key, the first of a key; an object's name stands for the object, a list for its first entry.

    Names, URLs and types of objects inside others belong to these and do not count.
    """
    found: dict[str, str] = {}
    kept = lambda v: v if isinstance(v, str) else json.dumps(v)

    def walk(value: object, inner: bool, depth: int) -> None:
        if isinstance(value, list):
            for entry in value:
                walk(entry, inner, depth + 1)
        if not isinstance(value, dict) or depth > DEEPEST:
            return
        for key, v in value.items():
            if key == "@graph" and isinstance(v, list):
                walk(v, False, depth + 1)
                continue
            one = v[0] if isinstance(v, list) and v else v
            if isinstance(one, dict):
                if one.get("name") is not None:
                    found.setdefault(key, kept(one["name"]))
                walk(one, True, depth + 1)
            elif not isinstance(v, list) and not (inner and key in ("name", "url", "@type")):
                found.setdefault(key, "" if v is None else kept(v))

    for text in texts:
        try:
            walk(json.loads(text), False, 0)
        except (ValueError, RecursionError):
            continue
    return found


def _flats(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in lists:
        for some in N.a_few(series, lambda x: sum(map(len, x)) if x is not None else 0):
            yield pd.Series([_flat(list(x)) if x is not None else {} for x in some], dtype=object)


def structured(html: Column) -> Column:
    """The scalars of a page's JSON-LD by key (a map). Python reads the JSON, whose order of keys decides; only the JSON is handed to it."""
    texts = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), M.COMMENT, ""), F.lit(M.JSON_LD), F.lit(1))
    return F.pandas_udf(_flats, "map<string,string>")(texts)


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(None).cast("string"))


def _from_markup(nodes: Column, name: str) -> Column:
    """The last resort: headings, times, the article, class names that hold a hint, ``itemprop``."""
    low = name.lower()
    said = lambda node, between="": N.text_of(nodes, node, between)
    head = lambda selector: F.get(N.select(nodes, selector), F.lit(0))
    holds = lambda test: F.get(F.filter(nodes, lambda n: (n["tag"] != N.TEXT) & test(n)), F.lit(0))
    prop = lambda pattern: holds(lambda n: F.coalesce(n["attributes"]["itemprop"].rlike(f"(?i){pattern}"), F.lit(False)))
    content = lambda node, between="": let(node, lambda n: _first(n["attributes"]["content"], said(n, between)))
    ways = []
    if low in TITLES:
        ways += [let(head(t), lambda n: said(n)) for t in ("h1", "h2")]
    if low in DATES:
        ways += [let(head("time"), lambda n: _first(n["attributes"]["datetime"], said(n))), content(prop("date"))]
    if low in SUMMARIES:
        ways.append(F.substring(let(head("article"), lambda n: said(n, " ")), 1, LONGEST))
    for hint in CLASS_NAMES.get(low, "").split():
        ways.append(F.substring(strip(content(holds(_classed(hint)), " ")), 1, LONGEST_HINT))
    ways.append(content(prop(rf"^\Q{name}\E$")))
    return _first(*ways)


def _classed(hint: str):
    return lambda n: F.exists(n["classes"], lambda c: F.lower(c).contains(hint))


def coerced(value: Column, declared: str | None) -> Column:
    """A value as text in the form of a declared type; one that cannot be converted stays as the page has it."""
    if declared in ("number", "integer"):
        number = F.nullif(F.regexp_extract(F.translate(value, ",$¥", ""), r"-?\d+(?:\.\d+)?", 0), F.lit(""))
        return F.coalesce((number.cast("double").cast("long") if declared == "integer" else number.cast("double")).cast("string"), value)
    if declared == "boolean":
        return F.lower(F.trim(value)).isin("true", "1", "yes", "y").cast("string")
    return value


def by_schema(pages: DataFrame, schema: dict, keep: tuple[str, ...] = ("page_id",), base: str = "url") -> DataFrame:
    """``keep``, data and sources (maps by field name), missing (names) of pages with ``html`` and a base URL.

    ``schema`` is ``{"properties": {name: {"type": ..}}}``; other keywords are ignored. A source is "json-ld", "meta" or
    "semantic-html"; a field that nothing gives has a null value, an empty source and stands in ``missing``.
    """
    wanted = {n: (s.get("type") if isinstance(s, dict) else None) for n, s in ((schema or {}).get("properties") or {}).items()}
    texts, strings = "array<string>", "map<string,string>"
    if not wanted:
        return pages.select(*keep, F.create_map().cast(strings).alias("data"), F.create_map().cast(strings).alias("sources"), F.array().cast(texts).alias("missing"))
    read = pages.select(*keep, M.page_metadata(F.col("html"), F.col(base)).alias("meta"), structured(F.col("html")).alias("flat"), N.page_nodes("html").alias("nodes"))

    def field(name: str) -> Column:
        low = name.lower()
        meta = [F.col("meta.raw_meta")[k] for k in META_NAMES.get(low, "").split()] + ([F.col(f"meta.{low}")] if low in DIRECT else [])
        ways = {"json-ld": _first(*[F.col("flat")[k] for k in DATA_NAMES.get(low, name).split()]), "meta": _first(*meta), "semantic-html": _from_markup(F.col("nodes"), name)}
        return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("source"))) for k, v in ways.items()], F.struct(F.lit(None).cast("string").alias("value"), F.lit("").alias("source")))

    found = read.select(*keep, *[field(n).alias(f"f{i}") for i, n in enumerate(wanted)])
    pairs = lambda value: F.map_from_arrays(F.array(*[F.lit(n) for n in wanted]), F.array(*[value(f"f{i}", t) for i, t in enumerate(wanted.values())]))
    missing = F.filter(F.array(*[F.when(F.col(f"f{i}.source") == "", F.lit(n)) for i, n in enumerate(wanted)]), lambda n: n.isNotNull())
    return found.select(*keep, pairs(lambda f, t: coerced(F.col(f"{f}.value"), t)).alias("data"), pairs(lambda f, t: F.col(f"{f}.source")).alias("sources"), missing.alias("missing"))

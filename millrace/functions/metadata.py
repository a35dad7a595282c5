"""What a page says about itself: title, meta tags, Open Graph and Twitter cards, JSON-LD, images, links. Columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.passages import let
from millrace.functions.text import decode_entities
from millrace.functions.web import absolute

#: How much of each kind a page's record holds.
MOST_META, MOST_NODES, MOST_DEPTH, MOST_IMAGES, MOST_LINKS = 200, 50, 3, 100, 200
COMMENT = r"(?s)<!--.*?-->"
CODE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
JSON_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
BLANKS = "^[ \t\r\n\f]+|[ \t\r\n\f]+$"

# The names of the tags read, and the record's fields they fill.
NAMED = {"description": "description", "author": "author", "robots": "robots", "viewport": "viewport", "generator": "generator", "theme-color": "theme_color"}
OPEN_GRAPH = {"title": "og_title", "description": "og_description", "image": "og_image", "url": "og_url", "type": "og_type", "site_name": "og_site_name"}
TWITTER = {"card": "twitter_card", "title": "twitter_title", "description": "twitter_description", "image": "twitter_image", "creator": "twitter_creator"}
ARTICLE = {"author": "article_author", "published_time": "article_published_time", "modified_time": "article_modified_time", "section": "article_section"}
#: Fields that hold URLs, made absolute.
LINKED = ("og_image", "og_url", "twitter_image")
UNLINKED = r"^(#|javascript:|mailto:|tel:)"


def trimmed(t: Column) -> Column:
    return F.regexp_replace(t, BLANKS, "")


def tags(html: Column, name: str) -> Column:
    """Opening tags of one name, whole."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)<{name}\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def attributes(tag: Column) -> Column:
    """(k, v) of a tag's attributes with a value, in order: names in lower case, values without quotes and references."""

    def pair(a: Column) -> Column:
        name = F.regexp_extract(a, r"^[^\s=]+", 0)
        value = F.regexp_replace(F.regexp_replace(a, r"^[^=]*=\s*", ""), r"""^(?s)["'](.*)["']$""", "$1")
        return F.struct(F.lower(name).alias("k"), decode_entities(value).alias("v"))

    return F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), pair)


def value(pairs: Column, name: str) -> Column:
    """The first value of an attribute, or the empty text."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"], F.lit(""))


def resolved(url: Column, base: Column) -> Column:
    """An absolute URL; empty stays empty, ``data:`` and a missing base leave it as it is."""
    return F.when((url == "") | url.rlike("^(https?://|data:)") | (F.coalesce(base, F.lit("")) == ""), url).otherwise(absolute(base, url))


def nodes(data: Column, depth: int = MOST_DEPTH) -> Column:
    """The objects of a JSON-LD value (a VARIANT), depth first: those of lists and of ``@graph`` lists after the object that holds them.

    Lists and graphs in each other are followed ``depth`` levels deep. Nulls and plain values hold none.
    """
    none = F.array().cast("array<variant>")
    items = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    own = F.when(F.try_variant_get(data, "$", "map<string,variant>").isNotNull(), F.array(data)).otherwise(none)
    if not depth:
        return own
    below = F.coalesce(items(data, "$"), items(data, '$["@graph"]'), none)
    return F.concat(own, F.flatten(F.transform(below, lambda v: nodes(v, depth - 1))))


def _is(of: Callable[[Column], Column], key: str) -> Callable[[Column], Column]:
    return lambda x: of(x) == key


def metas(html: Column) -> Column:
    """(name, property, content) of the meta tags, keys in lower case."""
    read = lambda p: F.struct(F.lower(value(p, "name")).alias("name"), F.lower(value(p, "property")).alias("property"), trimmed(value(p, "content")).alias("content"), value(p, "charset").alias("charset"))
    return F.transform(F.slice(tags(html, "meta"), 1, MOST_META), lambda t: let(attributes(t), read))


def page_metadata(html: Column, base: Column) -> Column:
    """A page's record as a struct; null and empty pages give one of empty fields.

    Of tags that repeat, the last counts; attributes without quotes and tags in any case are read, those
    in comments, scripts and styles are not. JSON-LD that is no JSON is skipped.
    """
    empty = F.array().cast("array<string>")
    page = F.regexp_replace(F.coalesce(html, F.lit("")), COMMENT, "")
    plain = F.regexp_replace(page, CODE, "")

    def record(found: Column, heads: Column, bare: Column) -> Column:
        latest = lambda some: F.coalesce(F.try_element_at(some, F.lit(-1))["content"], F.lit(""))
        last = lambda part, key: latest(F.filter(found, lambda m: m[part] == key))
        article = lambda m: F.when(m["name"].startswith("article:"), m["name"]).otherwise(m["property"])
        fields = {field: last("name", key) for key, field in NAMED.items()}
        fields |= {field: last("property", f"og:{key}") for key, field in OPEN_GRAPH.items()}
        fields |= {field: last("name", f"twitter:{key}") for key, field in TWITTER.items()}
        fields |= {field: latest(F.filter(found, _is(article, f"article:{key}"))) for key, field in ARTICLE.items()}
        fields |= {f: resolved(fields[f], base) for f in LINKED}
        keyed = F.filter(F.transform(found, lambda m: F.struct(F.when(m["name"] != "", m["name"]).otherwise(m["property"]).alias("k"), m["content"].alias("v"))), lambda m: (m["k"] != "") & (m["v"] != ""))
        raw = let(keyed, lambda pairs: F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda m: m["k"])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda m: m["k"] == k), -1)["v"]))))
        headed = lambda test: F.get(F.filter(heads, lambda p: F.exists(F.split(value(p, "rel"), r"\s+"), test)), F.lit(0))
        href = lambda test: resolved(F.coalesce(value(headed(test), "href"), F.lit("")), base)
        images = F.transform(F.slice(tags(bare, "img"), 1, MOST_IMAGES), lambda t: let(attributes(t), lambda p: F.struct(resolved(value(p, "src"), base).alias("src"), *[value(p, a).alias(a) for a in ("alt", "title", "width", "height")])))
        anchors = F.slice(F.regexp_extract_all(bare, F.lit(r"""(?is)<a\b(?=[^>]*\bhref\s*=)(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</a\s*>|$)"""), F.lit(0)), 1, MOST_LINKS)

        def link(a: Column) -> Column:
            said = F.substring(trimmed(decode_entities(F.regexp_replace(a, "<[^>]*>", ""))), 1, 200)
            return let(attributes(F.get(tags(a, "a"), F.lit(0))), lambda p: F.struct(value(p, "href").alias("raw"), resolved(value(p, "href"), base).alias("href"), said.alias("text"), *[value(p, x).alias(x) for x in ("title", "rel", "target")]))

        links = F.transform(F.filter(F.transform(anchors, link), lambda x: (x["raw"] != "") & ~x["raw"].rlike(UNLINKED)), lambda x: F.struct(*[x[c].alias(c) for c in ("href", "text", "title", "rel", "target")]))
        scripts = F.filter(F.transform(F.regexp_extract_all(page, F.lit(JSON_LD), F.lit(1)), lambda s: F.try_parse_json(trimmed(s))), lambda v: v.isNotNull())
        json_ld = F.slice(F.flatten(F.transform(scripts, lambda v: nodes(v))), 1, MOST_NODES)
        return F.struct(
            trimmed(decode_entities(F.regexp_extract(bare, r"(?is)<title\b[^>]*>(.*?)</title", 1))).alias("title"),
            F.coalesce(value(attributes(F.get(tags(bare, "html"), F.lit(0))), "lang"), F.lit("")).alias("language"),
            F.coalesce(F.get(F.filter(found, lambda m: m["charset"] != ""), F.lit(0))["charset"], F.lit("")).alias("charset"),
            F.filter(F.transform(F.split(last("name", "keywords"), ","), trimmed), lambda k: k != "").alias("keywords"),
            href(lambda r: r == "canonical").alias("canonical_url"),
            href(lambda r: F.contains(F.lower(r), F.lit("icon"))).alias("favicon"),
            *[c.alias(f) for f, c in fields.items()],
            F.coalesce(F.transform(F.filter(found, lambda m: article(m) == "article:tag"), lambda m: m["content"]), empty).alias("article_tags"),
            raw.alias("raw_meta"), json_ld.alias("json_ld"), F.filter(images, lambda i: i["src"] != "").alias("images"), links.alias("links"),
        )

    return let(plain, lambda bare: let(metas(bare), lambda found: let(F.transform(tags(bare, "link"), attributes), lambda heads: record(found, heads, bare))))


def best(record: Column, field: str) -> Column:
    """A record's title, description or image: of Open Graph, else of Twitter, else of the page itself."""
    own = record[field] if field != "image" else F.lit("")
    return F.coalesce(*[F.nullif(record[f"{k}_{field}"], F.lit("")) for k in ("og", "twitter")], own)

"""Records of pages on written heads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import metadata as M

BASE = "https://tides.example.org/a/b.html"


def record(spark, html, base=BASE):
    row = spark.createDataFrame([(html, base)], "html string, base string").select(M.page_metadata(F.col("html"), F.col("base")).alias("m"))
    row = row.select("m.*", M.best(F.col("m"), "title").alias("best_title"), M.best(F.col("m"), "image").alias("best_image"), M.best(F.col("m"), "description").alias("best_description"))
    return row.withColumn("json_ld", F.transform("json_ld", lambda v: v.cast("string"))).first()


@pytest.mark.parametrize("html", [None, "", "no tags", "<meta>", "<meta name=>", "<title>", "< <meta"])
def test_pages_without_metadata(spark, html):
    r = record(spark, html)
    assert (r["title"], r["description"], r["keywords"], r["json_ld"], r["images"], r["links"], r["raw_meta"]) == ("", "", [], [], [], [], {})


def test_tags_in_any_form(spark):
    r = record(spark, """<!doctype html><HTML lang='nl'><head><meta charset=utf-16><TITLE> Tides &amp; bars
    </TITLE><META CONTENT='says "five > four"' Name=DESCRIPTION><meta name="keywords" content=" sea,, bar , "><meta name=robots content=noindex>
    <meta name="viewport" content="width=1"><meta name=generator content=pen><meta name="theme-color" content="#fff">
    <!-- <meta name="author" content="nobody"> --><script>var x = '<meta name="author" content="script">';</script></head>""")
    assert (r["title"], r["language"], r["charset"], r["description"], r["keywords"]) == ("Tides & bars", "nl", "utf-16", 'says "five > four"', ["sea", "bar"])
    assert (r["robots"], r["viewport"], r["generator"], r["theme_color"], r["author"]) == ("noindex", "width=1", "pen", "#fff", "")


def test_cards_and_what_is_best(spark):
    head = '<title>own</title><meta name=description content=d><meta name="twitter:title" content="bird"><meta name="twitter:image" content="t.png"><meta name="twitter:card" content="summary">'
    r = record(spark, head)
    assert (r["best_title"], r["best_image"], r["best_description"], r["twitter_card"]) == ("bird", "https://tides.example.org/a/t.png", "d", "summary")
    r = record(spark, head + '<meta property="og:title" content="open"><meta property="og:image" content="/o.png"><meta property="og:description" content="od"><meta property="OG:type" content="website">')
    assert (r["best_title"], r["best_image"], r["best_description"], r["og_type"]) == ("open", "https://tides.example.org/o.png", "od", "website")


def test_repeated_tags_and_articles(spark):
    r = record(spark, '<meta name=author content=a><meta name=author content=b><meta property="article:tag" content=x><meta name="article:tag" content=y><meta property="article:author" content="W"><meta name="article:section" content="Sea">')
    assert (r["author"], r["article_tags"], r["article_author"], r["article_section"]) == ("b", ["x", "y"], "W", "Sea")
    assert r["raw_meta"] == {"author": "b", "article:tag": "y", "article:author": "W", "article:section": "Sea"}


def test_link_elements(spark):
    r = record(spark, '<link rel="stylesheet" href="s.css"><link rel="nofollow canonical" href="//x.example.net/c"><link rel="Shortcut Icon" href="i.ico"><link rel=icon href=second.ico>')
    assert (r["canonical_url"], r["favicon"]) == ("https://x.example.net/c", "https://tides.example.org/a/i.ico")
    assert record(spark, '<link rel="canonical" href="c">', None)["canonical_url"] == "c"


def plain_nodes(data, depth=0):
    if depth > M.MOST_DEPTH:
        return []
    if isinstance(data, list):
        return [n for x in data for n in plain_nodes(x, depth + 1)]
    if isinstance(data, dict):
        graph = data.get("@graph")
        return [data, *(n for x in graph for n in plain_nodes(x, depth + 1))] if isinstance(graph, list) else [data]
    return []


DATA = [{"a": 1}, [{"a": 1}, [{"b": 2}, [{"c": 3}, [{"d": 4}]]]], {"@graph": [{"x": 1}, {"@graph": [{"y": [1, None]}, {"@graph": [{"z": {}}, {"@graph": [{"deep": 1}]}]}]}], "n": 1}, {"@graph": {"no": "list"}}, [], 7, "text", None, {"@graph": []}]


def test_nodes_of_json_ld(spark):
    html = "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in DATA) + "<script type='application/ld+json'>{broken</script><script type=application/ld+json> {\"last\": 1} </script>"
    assert [json.loads(n) for n in record(spark, html)["json_ld"]] == [n for d in DATA for n in plain_nodes(d)] + [{"last": 1}]


def test_most_nodes(spark):
    html = f'<script type="application/ld+json">{json.dumps([{"i": i} for i in range(80)])}</script>'
    assert len(record(spark, html)["json_ld"]) == M.MOST_NODES


def test_images_and_links(spark):
    r = record(spark, """<img src="p.png" alt="A &lt; B" width=3><img alt="none"><img src="data:x"><a href="#top">up</a><a href="mailto:a@b">m</a><a name=x>no</a>
    <a class=c href='q?x=1&amp;y=2' rel="nofollow me" target=_blank> some <b>bold</b> text </a><a href="//h.example.net">out""")
    assert [i.asDict() for i in r["images"]] == [{"src": "https://tides.example.org/a/p.png", "alt": "A < B", "title": "", "width": "3", "height": ""}, {"src": "data:x", "alt": "", "title": "", "width": "", "height": ""}]
    assert [(x["href"], x["text"], x["rel"], x["target"]) for x in r["links"]] == [("https://tides.example.org/a/q?x=1&y=2", "some bold text", "nofollow me", "_blank"), ("https://h.example.net", "out", "", "")]

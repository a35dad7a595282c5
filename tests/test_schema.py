"""Fields by schema on written pages, with where they came from."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from millrace.functions import schema as S


def fields(spark, html, **types):
    df = spark.createDataFrame([(1, html, "https://tides.example.org/a/")], "page_id long, html string, url string")
    r = S.by_schema(df, {"type": "object", "properties": {n: {"type": t} if t else {} for n, t in types.items()}}).first()
    return r["data"], r["sources"], r["missing"]


def data(*values):
    return "".join(f'<script type="application/ld+json">{json.dumps(v) if not isinstance(v, str) else v}</script>' for v in values)


def test_structured_data_comes_first(spark):
    page = data("{broken", {"@type": "Product", "name": "Gauge", "offers": {"@type": "Offer", "price": "1,299.50", "priceCurrency": "EUR", "name": "spring offer"}, "author": [{"name": "A. Writer"}, {"name": "B"}], "brand": {"name": "Sea & Co"}})
    page += '<meta property="og:title" content="Card"><h1>Heading</h1>'
    found, sources, missing = fields(spark, page, title=None, price="number", currency="string", author="string", brand=None)
    assert found == {"title": "Gauge", "price": "1299.5", "currency": "EUR", "author": "A. Writer", "brand": "Sea & Co"}
    assert set(sources.values()) == {"json-ld"} and missing == []


def test_meta_then_markup(spark):
    page = """<meta property="og:description" content="Open text"><meta name="author" content="Meta Writer"><h2>Second</h2><h1> Tide <b>tables</b></h1>
    <time datetime="2024-03-01">1 March</time><p class="Item-Price">$ 12,5</p><span itemprop="Depth" content="9">nine</span><article>Long <i>text</i></article>"""
    found, sources, missing = fields(spark, page, title="string", description=None, author=None, date=None, price="integer", depth="integer", summary=None, nothing="array", image=None)
    assert found == {"title": "Tidetables", "description": "Open text", "author": "Meta Writer", "date": "2024-03-01", "price": "125", "depth": "9", "summary": "Long text", "nothing": None, "image": None}
    assert sources == {"title": "semantic-html", "description": "meta", "author": "meta", "date": "semantic-html", "price": "semantic-html", "depth": "semantic-html", "summary": "semantic-html", "nothing": "", "image": ""}
    assert missing == ["nothing", "image"]


def test_graphs_and_objects_inside_others(spark):
    page = data({"@graph": [{"@type": "Site", "publisher": {"name": "Press", "url": "https://press.example.net"}}, {"@type": "Article", "headline": "In the graph", "description": "d", "dateModified": None}]}, {"description": "later"})
    found, sources, missing = fields(spark, page, title=None, description=None, publisher=None, url=None, modified=None)
    assert (found["title"], found["description"], found["publisher"], found["url"]) == ("In the graph", "d", "Press", None)
    assert missing == ["url", "modified"]


@pytest.mark.parametrize(("text", "declared", "value"), [("about 3.7 m", "number", "3.7"), ("-4", "integer", "-4"), ("none", "number", "none"), (" Yes ", "boolean", "true"), ("no", "boolean", "false"), ("x", "array", "x")])
def test_types(spark, text, declared, value):
    assert fields(spark, f'<b itemprop="depth">{text}</b>', depth=declared)[0]["depth"] == value


@pytest.mark.parametrize("page", [None, "", "<", data("[]", "7", "null"), "<p class=>x"])
def test_pages_that_say_nothing(spark, page):
    assert fields(spark, page, title=None, price="number")[2] == ["title", "price"]
    assert fields(spark, page) == ({}, {}, [])


def test_deep_data_is_read_without_failing():
    deep = "[" * 2000 + '{"name": "x"}' + "]" * 2000
    assert S._flat([deep, '{"a": ' * 1200 + "1" + "}" * 1200, '{"name": "kept"}'])["name"] == "kept"


def test_fields_of_every_page(spark):
    """Heads are of five kinds by page_id, which says what each field must be."""
    import re

    import duckdb

    from millrace.plans.catalog import QUERIES

    path = "/root/testdata/sf0.001"
    pages = dict(duckdb.execute(f"SELECT page_id, html FROM '{path}/pages.parquet'").fetchall())
    rows = QUERIES["schema_fields"](spark, path).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        i, kind = r["page_id"], r["page_id"] % 5
        title = f"Card {i}" if kind == 2 else re.search("<title>(.*?)</title>", pages[i])[1].strip()
        assert (r["title"], r["title_source"]) == (title, "meta")
        assert (r["author"], r["author_source"]) == {1: ("A. Writer", "meta"), 4: (f"second {i}", "meta")}.get(kind, (None, ""))
        assert (r["n"], r["n_source"]) == ((str(i), "json-ld") if kind == 3 else (None, ""))
        assert r["keywords"] == {1: f"one, two ,,p{i}", 4: f"t{i}"}.get(kind) and r["missing"] is None
        assert (r["description"], r["description_source"]) == (f"About page {i} & more", "meta") if kind == 1 else r["description_source"] in ("semantic-html", "")
        assert r["image_source"] == ("meta" if kind == 2 else "")


def test_structured_data_of_a_large_batch_comes_a_few_pages_at_a_time():
    lists = pd.Series([['{"name": "' + "n" * 2000 + '"}', "{"], None, []] * 1000)
    parts = list(S._flats(iter([lists])))
    assert sum(map(len, parts)) == 3000 and max(map(len, parts)) < 1000
    assert [dict(x) for x in pd.concat(parts)[:3]] == [{"name": "n" * 2000}, {}, {}]

"""Selectors and rules over node tables, against a plain tree on every page of the smallest tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import nodes as N
from millrace.plans.catalog import QUERIES
from millrace.plans.page_queries import RULES

DATA = "/root/testdata/sf0.001"


class Tree(HTMLParser):
    """Elements as nested lists: [tag, attributes, children, parent]."""

    def __init__(self, page):
        super().__init__()
        self.root = self.here = ["", {}, [], None]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        e = [tag, {k: v or "" for k, v in reversed(attrs)}, [], self.here]
        self.here[2].append(e)
        if tag not in N.VOID:
            self.here = e

    def handle_startendtag(self, tag, attrs):
        self.here[2].append([tag, {k: v or "" for k, v in reversed(attrs)}, [], self.here])

    def handle_endtag(self, tag):
        e = self.here
        while e[3] is not None and e[0] != tag:
            e = e[3]
        if e[3] is not None:
            self.here = e[3]

    def handle_data(self, data):
        self.here[2].append(data)


def walk(e):
    for c in e[2]:
        if isinstance(c, list):
            yield c
            yield from walk(c)


def said(e):
    return "".join(said(c) if isinstance(c, list) and c[0] not in N.HIDDEN else c.strip() if isinstance(c, str) else "" for c in e[2])


def meets(e, want):
    def has(name, how, value):
        v = e[1].get(name)
        if v is None:
            return False
        if how is None or (value == "" and how not in ("=", "|=")):
            return how is None
        return {"=": v == value, "~=": value in v.split(), "^=": v.startswith(value), "$=": v.endswith(value), "*=": value in v, "|=": v == value or v.startswith(value + "-")}[how]

    return (want.tag in (None, e[0])) and all(e[1].get("id") == i for i in want.ids) and all(c in e[1].get("class", "").split() for c in want.classes) and all(has(*a) for a in want.attributes)


def hangs(e, chain):
    if not meets(e, chain[-1]):
        return False
    if len(chain) == 1:
        return True
    up = e[3]
    while up is not None and up[0]:
        if hangs(up, chain[:-1]):
            return True
        if chain[-1].child:
            return False
        up = up[3]
    return False


def plain_select(page, selector):
    ways = N.parse_selector(selector)
    return [e for e in walk(Tree(page).root) if any(hangs(e, c) for c in ways)]


def plain_value(page, rule):
    def value(e):
        v = e[1].get(rule.attribute) if rule.attribute else said(e)
        if v is None or not rule.pattern:
            return v if v is None else v.strip()
        m = re.search(rule.pattern, v.strip())
        return m and (m[1] if m.re.groups else m[0])

    taken = plain_select(page, rule.selector)
    if rule.multiple:
        return [v for e in taken if (v := value(e)) is not None]
    found = value(taken[0]) if taken else None
    return rule.default if found is None else found


def test_rules_on_every_page(spark):
    pages = dict(duckdb.execute(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall())
    rows = QUERIES["page_rules"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        for rule in RULES:
            assert r[rule.name] == plain_value(pages[r["page_id"]] or "", rule), rule


PAGE = """<div id=a class="x y"><p>one <b>two</b></p><section><p class=x data-k="tide-1">three<p>four<script>var p = "<p>no</p>";</script></section></div></p>
<ul><li>i<ul><li class="y x">ii</li></ul></li><li>iii</ul><p data-k='' title="A b  c">five<br>six<img alt="q"/></p><div><div><div><p>deep</div></div></div><p id=a>last"""
SELECTORS = ["p", "div p", "div > p", "#a", "p#a", ".x", ".x.y", "ul li", "ul > li", "li li", "div div > p", "section > p.x", "[data-k]", "p[data-k=tide-1]", "[data-k^='tide']", "[data-k$='1']", "[data-k*='de-']", "[data-k='']", "[title~=b]", "[data-k|=tide]", "*", "div, .x, p", "b, p b", "nothing", "div * p", "body p", "[data-k^='']"]


@pytest.mark.parametrize("part", range(3))
def test_selectors_by_a_tree(spark, part):
    mine = SELECTORS[part::3]
    df = spark.createDataFrame([(PAGE,)], "html string").select(N.page_nodes("html").alias("n"))
    row = df.select(*[F.transform(N.select(F.col("n"), s), lambda e: N.text_of(F.col("n"), e)).alias(f"s{i}") for i, s in enumerate(mine)]).first()
    assert {s: row[f"s{i}"] for i, s in enumerate(mine)} == {s: [said(e) for e in plain_select(PAGE, s)] for s in mine}


def test_pages_without_nodes_and_long_ones(spark):
    deep = "<div>" * 3000 + "x"
    df = spark.createDataFrame([(None,), ("",), ("plain",), ("</p></div>",), ("<p", ), (deep,)], "html string").select(N.page_nodes("html").alias("n"))
    rows = df.select(F.size("n").alias("size"), *N.extract_all(F.col("n"), [N.Rule("a", "p", default="none"), N.Rule("b", "p", multiple=True), N.Rule("c", "p")])).collect()
    assert [r["size"] for r in rows][:4] == [0, 0, 1, 0] and rows[-1]["size"] == 3001
    assert all((r["a"], r["b"], r["c"]) == ("none", [], None) for r in rows)


@pytest.mark.parametrize("selector", ["", "p >", "p:first-child", "p,,b", "[x", "."])
def test_selectors_that_cannot_be_read(selector):
    with pytest.raises(ValueError):
        N.parse_selector(selector)


def test_nodes_of_a_large_batch_come_a_few_pages_at_a_time():
    pages = pd.Series([None, "", *["<p>" + "<b>x</b>" * 500] * 2000, "<i>" * 400_000])
    sizes, at = [], 0
    for some in N._parse(iter([pages])):
        sizes.append(sum(len(p or "") for p in pages[at : at + len(some)]))
        at += len(some)
        assert len(some) == 1 or sizes[-1] < 250_000
    assert at == len(pages) and len(sizes) > 30

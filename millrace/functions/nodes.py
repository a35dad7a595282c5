"""Pages as tables of nodes, selectors as interval tests over them, and values taken by rules.

A page is parsed once into its nodes in page order. Each node knows the last node inside it, so "b lies in a" is
``a.node < b.node <= a.last``: selectors, ancestors and texts become filters over one array, without walking a tree
and without a shuffle. Only the parsing runs in Python; it keeps a stack and looks at each character once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.passages import BLANK, let, strip

NODE = "struct<node: int, last: int, parent: int, tag: string, id: string, classes: array<string>, attributes: map<string,string>, text: string>"
#: What a text node is called.
TEXT = "#text"
# Elements of the public HTML standard that have no content, and those whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "template")


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.stack: list[dict] = []
        self.open: dict[str, int] = {}

    def _add(self, tag: str, attributes: list[tuple[str, str | None]] = (), text: str | None = None) -> dict:
        kept: dict[str, str] = {}
        for name, value in attributes:
            kept.setdefault(name, value or "")
        at = len(self.found)
        node = {"node": at, "last": at, "parent": self.stack[-1]["node"] if self.stack else None, "tag": tag, "id": kept.get("id"), "classes": kept.get("class", "").split(), "attributes": kept, "text": text}
        self.found.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def _pop(self) -> str:
        node = self.stack.pop()
        node["last"] = len(self.found) - 1
        self.open[node["tag"]] -= 1
        return node["tag"]

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self._add(TEXT, text=data)

    def nodes(self, page: str) -> list[dict]:
        self.feed(page)
        self.close()
        while self.stack:
            self._pop()
        return self.found


#: Characters of pages that are parsed at once: their nodes take many times as much memory, whatever a batch holds.
AT_ONCE = 200_000


def a_few(values: Iterable, size: Callable[[object], int]) -> Iterator[list]:
    """Consecutive values in lists of about AT_ONCE, or of one larger value."""
    some, held = [], 0
    for value in values:
        some.append(value)
        held += size(value)
        if held >= AT_ONCE or len(some) >= 1000:
            yield some
            some, held = [], 0
    if some:
        yield some


def _parse(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in pages:
        for some in a_few(series, lambda p: len(p or "")):
            yield pd.Series([_Nodes().nodes(p) if p else [] for p in some], dtype=object)


def page_nodes(html: Column | str) -> Column:
    """The nodes of a page in page order, elements and texts; null and empty pages have none.

    An end tag closes everything that is open inside its element and is void if nothing of its name is open;
    what stays open ends with the page; of attributes that repeat the first counts.
    """
    return F.pandas_udf(_parse, f"array<{NODE}>")(html)  # declared here: a type text needs a session


@dataclass(frozen=True)
class Compound:
    """Conditions on one element, and how it hangs together with the one before: inside it, or its child."""

    child: bool
    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str | None, str | None], ...]


_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~^$*|]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")


def parse_selector(selector: str) -> list[list[Compound]]:
    """Alternatives (between commas) of compounds: tags, ``#id``, ``.class``, ``[name]``, ``[name=value]`` and ``~= ^= $= *=``, with blanks or ``>`` between."""
    out = []
    for alternative in selector.split(","):
        chain, child = [], False
        rest = alternative.strip()
        while rest:
            if rest[0] == ">":
                child, rest = True, rest[1:].lstrip()
                continue
            tag, ids, classes, attributes = None, [], [], []
            at = 0
            while at < len(rest) and not rest[at].isspace() and rest[at] != ">":
                m = _PART.match(rest, at)
                if not m:
                    raise ValueError(f"cannot read selector {selector!r} at {rest[at:]!r}")
                if m["tag"]:
                    tag = None if m["tag"] == "*" else m["tag"].lower()
                elif m["id"]:
                    ids.append(m["id"])
                elif m["cls"]:
                    classes.append(m["cls"])
                else:
                    attributes.append((m["name"].lower(), m["how"], next((v for v in (m["a"], m["b"], m["c"]) if v is not None), None)))
                at = m.end()
            chain.append(Compound(child, tag, tuple(ids), tuple(classes), tuple(attributes)))
            child, rest = False, rest[at:].lstrip()
        if not chain or child:
            raise ValueError(f"empty selector in {selector!r}")
        out.append(chain)
    return out


def _meets(node: Column, want: Compound) -> Column:
    holds = node["tag"] == want.tag if want.tag else node["tag"] != TEXT
    for i in want.ids:
        holds = holds & F.coalesce(node["id"] == i, F.lit(False))
    for c in want.classes:
        holds = holds & F.array_contains(node["classes"], c)
    for name, how, value in want.attributes:
        has = node["attributes"][name]
        test = {
            None: lambda: has.isNotNull(), "=": lambda: has == value, "~=": lambda: F.array_contains(F.split(has, BLANK), value), "^=": lambda: has.startswith(value),
            "$=": lambda: has.endswith(value), "*=": lambda: has.contains(value), "|=": lambda: (has == value) | has.startswith(value + "-"),
        }[how]()
        holds = holds & F.coalesce(test, F.lit(False)) & F.lit(value != "" or how in (None, "=", "|="))
    return holds


def select(nodes: Column, selector: str) -> Column:
    """The elements that a selector takes, in page order, each once."""

    def chain(compounds: list[Compound], found: Column | None) -> Column:
        want = compounds[0]
        if found is None:
            here = F.filter(nodes, lambda n: _meets(n, want))
        elif want.child:
            here = let(F.transform(found, lambda a: a["node"]), lambda parents: F.filter(nodes, lambda n: _meets(n, want) & F.array_contains(parents, F.coalesce(n["parent"], F.lit(-1)))))
        else:
            here = F.filter(nodes, lambda n: _meets(n, want) & F.exists(found, lambda a: (a["node"] < n["node"]) & (n["node"] <= a["last"])))
        return here if len(compounds) == 1 else let(here, lambda h: chain(compounds[1:], h))

    ways = [chain(c, None) for c in parse_selector(selector)]
    if len(ways) == 1:
        return ways[0]
    taken = F.array_distinct(F.flatten(F.array(*[F.transform(w, lambda n: n["node"]) for w in ways])))
    return let(taken, lambda t: F.filter(nodes, lambda n: F.array_contains(t, n["node"])))


def text_of(nodes: Column, node: Column, between: str = "") -> Column:
    """The texts inside an element, each without blanks around it, joined; scripts, styles and templates inside say nothing."""
    inside = lambda n, a: (a["node"] < n["node"]) & (n["node"] <= a["last"])
    within = F.slice(nodes, node["node"] + 1, node["last"] - node["node"] + 1)
    hidden = F.filter(within, lambda n: n["tag"].isin(*HIDDEN) & (n["node"] > node["node"]))
    said = let(hidden, lambda h: F.filter(within, lambda n: (n["tag"] == TEXT) & ~F.exists(h, lambda a: inside(n, a))))
    return F.array_join(F.filter(F.transform(said, lambda n: strip(n["text"])), lambda t: t != ""), between)


@dataclass(frozen=True)
class Rule:
    """A value of a page: of the elements that ``selector`` takes, the text or an attribute, the part that a pattern finds (its first group if it has one), of the first or of all."""

    name: str
    selector: str
    attribute: str | None = None
    pattern: str | None = None
    multiple: bool = False
    default: str | None = None


def extract(nodes: Column, rule: Rule) -> Column:
    """A rule's value: an array of texts if ``multiple``, else a text or the default.

    Elements without the attribute, or whose value the pattern does not find, give none. A single value looks at the first
    element only; without any element all rules give their default (an empty array if they have none).
    """

    def value(node: Column) -> Column:
        raw = strip(node["attributes"][rule.attribute.lower()] if rule.attribute else text_of(nodes, node))
        if rule.pattern is None:
            return raw
        group, pattern = 1 if re.compile(rule.pattern).groups else 0, f"(?U){rule.pattern}"  # classes know all letters
        return let(raw, lambda r: F.when(r.rlike(pattern), F.regexp_extract(r, pattern, group)))

    def of(taken: Column) -> Column:
        if rule.multiple:
            empty = F.array(F.lit(rule.default)) if rule.default is not None else F.array().cast("array<string>")
            return F.when(F.size(taken) == 0, empty).otherwise(F.filter(F.transform(taken, value), lambda v: v.isNotNull()))
        return F.coalesce(value(F.get(taken, F.lit(0))), F.lit(rule.default).cast("string"))

    return let(select(nodes, rule.selector), of)


def extract_all(nodes: Column, rules: list[Rule]) -> list[Column]:
    return [extract(nodes, r).alias(r.name) for r in rules]

"""Main-text extraction as a maximum-scoring subsequence.

A page is read as one sequence of words and tags, in blocks that block-level tags end. A word scores
by what labelled pages teach about its block: the elements around it and the names these bear, the
block's own tag, length and links, and the words in it. A logistic model learns these weights, so
words of the kind that labelled pages hold as content score positive and others negative; tags score
negative by how often they open boilerplate. One linear scan finds the contiguous region with the best
total; runs inside it that score less than ``-HOLE`` are left out as holes, each of which costs that
much. So neither a block's score nor its size decides alone: a block that scores below zero stays where the
text goes on around it, and one above zero goes where boilerplate parts it from the text. No name
condemns a block: names are features like others, and one that no labelled page has weighs nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of
from millrace.llm.labelled_pages import labelled_pages

# Element classes of the public HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Inline elements whose own elements are none of the page's.
FOREIGN = frozenset(("math", "svg"))
#: Elements whose content is no text of the page, and form controls.
RAW = frozenset("script style noscript template iframe textarea title select button".split())
#: Elements that an opening tag of the same set closes if it is the innermost one.
SIBLINGS = frozenset("p li dt dd tr td th option".split())

#: Elements that only a wrapper of the page or of its article holds.
LANDMARKS = frozenset("article main nav footer".split())

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_TERM = re.compile(r"\w+|©")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words of names that say what a page has or lacks, not what an element is.
_STATES = frozenset("no has with without is not".split())
#: Scale of a term's share of its block, against features that are 1: the smaller, the less a term can weigh.
TERM_SCALE = 3.0
#: What a hole in the region costs, in units of a word's score.
HOLE = 3.0


@dataclass(slots=True)
class Element:
    """A block element: the features of its names, and whether it holds a landmark."""

    tag: str
    names: tuple[str, ...]
    wraps: bool = False


@dataclass(slots=True)
class Block:
    """Text between two block tags."""

    tag: str = ""
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    words: int = 0
    opened: list[str] = field(default_factory=list)


@lru_cache(maxsize=20_000)
def names_of(attributes: str) -> tuple[str, ...]:
    """Features of an element's class, id and role: whole names, and the parts of compound names."""
    out = []
    for _, *values in _ATTRIBUTE.findall(attributes):
        for name in next((v for v in values if v), "").lower().split():
            out.append(f"n:{name}")
            parts = re.split(r"[-_]+", name)
            if len(parts) > 1 and parts[0] not in _STATES:
                out += [f"f:{parts[0]}", *(f"l:{p}" for p in parts[1:])]
    return tuple(dict.fromkeys(out))


def parse(page: str) -> tuple[list[Block], list[tuple[int, Element | None]]]:
    """Blocks, and the steps (1 element opens, -1 it ends, 0 a block begins) in page order. Linear in the page's length."""
    out = [Block()]
    steps: list[tuple[int, Element | None]] = [(0, None)]
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    links, foreign, at, size, quoted = 0, 0, 0, len(page), True

    def text(piece: str) -> None:
        out[-1].parts.append(piece)
        n = len(piece.split())
        out[-1].words += n
        if links:
            out[-1].linked += n

    def close(element: Element) -> None:
        if stack and (element.wraps or element.tag in LANDMARKS):
            stack[-1].wraps = True
        open_tags[element.tag] -= 1
        steps.append((-1, element))

    while at < size:
        here = page.find("<", at)
        if here < 0:
            text(page[at:])
            break
        if here > at:
            text(page[at:here])
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), here):
            end = page.find(">", here)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, here + 1)
        if name is None:
            text("<")
            at = here + 1
            continue
        rest = _REST.match(page, name.end()) if quoted else None
        if rest is None:  # a quote that never ends: from here on quotes do not shelter a ">"
            quoted = False
            end = page.find(">", name.end())
            at = size if end < 0 else end + 1
            attributes = page[name.end() : max(name.end(), at - 1)] if end >= 0 else ""
        else:
            at = rest.end()
            attributes = page[name.end() : at - 1]
        tag, closing = name[1].lower(), page[here + 1] == "/"
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            out[-1].parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in FOREIGN:
            foreign = max(0, foreign + (-1 if closing else not attributes.endswith("/")))
        if tag in INLINE or foreign:
            continue
        if closing:
            if open_tags[tag]:
                while True:
                    element = stack.pop()
                    close(element)
                    if element.tag == tag:
                        break
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in SIBLINGS and stack and stack[-1].tag == tag:
                close(stack.pop())
            stack.append(Element(tag, names_of(attributes) if attributes else ()))
            open_tags[tag] += 1
            steps.append((1, stack[-1]))
        links = 0
        out.append(Block(stack[-1].tag if stack else ""))
        out[-1].opened.append(f"/{tag}" if closing else tag)
        steps.append((0, None))
    while stack:
        close(stack.pop())
    return out, steps


def clean(block: Block) -> str:
    return " ".join(html.unescape("".join(block.parts)).split())


def around(element: Element) -> tuple[str, ...]:
    """Features that an element gives to the blocks in it; one that holds a landmark is told apart."""
    wraps = "+" if element.wraps else ""
    return (f"e:{element.tag}{wraps}", *(f"{n}{wraps}" for n in element.names))


def shape(block: Block, line: str) -> tuple[str, ...]:
    """Features of a block's own form."""
    n = block.words
    length = "1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20"
    link = "link" if 2 * block.linked > n else "plain"
    return (f"b:{block.tag}", f"s:{length}", f"s:{link}", f"s:{'end' if line[-1:] in '.!?:;…。' else 'open'}")


def terms_of(line: str) -> list[str]:
    return _TERM.findall(line.lower())


@dataclass(frozen=True)
class Weights:
    """Log-odds of features; of terms, by their share of a block's words; of tags that open blocks."""

    features: dict[str, float]
    terms: dict[str, float]
    tags: dict[str, float]
    tag: float = -0.05

    def of(self, name: str) -> float:
        """A feature's weight; a wrapper's is that of any element where none was learned for it."""
        return self.features.get(name, self.features.get(name.rstrip("+"), 0.0))

    def of_terms(self, line: str) -> float:
        terms = terms_of(line)
        return sum(self.terms.get(t, 0.0) for t in terms) / max(1, len(terms))


def block_scores(page: str, weights: Weights) -> tuple[list[str], list[float], list[Block]]:
    """Lines, the score of a word in each, and the blocks. What surrounds a block is summed as elements open and end."""
    found, steps = parse(page)
    active: Counter[str] = Counter()
    lines, scores, at, context = [], [], 0, weights.features.get("bias", 0.0)
    for step, element in steps:
        if element is None:
            block = found[at]
            at += 1
            line = clean(block) if block.words else ""
            own = sum(weights.features.get(f, 0.0) for f in shape(block, line)) + weights.of_terms(line) if line else 0.0
            lines.append(line)
            scores.append(max(-4.0, min(4.0, context + own)))
            continue
        for name in around(element):
            weight = weights.of(name)
            if not weight:
                continue
            active[name] += step
            if active[name] == (1 if step > 0 else 0):
                context += step * weight
    return lines, scores, found


def learn(labelled: list[tuple[str, str]], rounds: int = 800, rate: float = 1.0, ridge: float = 3e-5, least: int = 4) -> Weights:
    """Weights from (page, its main text): a logistic model over blocks, every feature seen in ``least`` blocks or more.

    A term's value in a block is its share of the words, so one word does not turn a long paragraph. A
    tag's weight is the log-odds that a block it opens is content, shifted so that no tag scores above a small loss.
    """
    rows: list[tuple[dict[str, float], int]] = []
    seen: Counter[str] = Counter()
    tag_good, tag_bad = Counter(), Counter()
    for page, main in labelled:
        wanted = Counter(main.split("\n"))
        found, steps = parse(page)
        active: Counter[str] = Counter()
        at = 0
        for step, element in steps:
            if element is not None:
                for name in around(element):
                    active[name] += step
                continue
            block = found[at]
            at += 1
            line = clean(block) if block.words else ""
            if not line:
                continue
            hit = wanted[line] > 0
            wanted[line] -= hit
            terms = terms_of(line)
            values = {f: 1.0 for f, n in active.items() if n > 0} | {f: 1.0 for f in shape(block, line)} | {f"t:{t}": TERM_SCALE * n / len(terms) for t, n in Counter(terms).items()}
            rows.append((values, int(hit)))
            seen.update(values)
            (tag_good if hit else tag_bad).update(t.lstrip("/") for t in block.opened)
    columns = {f: i for i, f in enumerate([*(f for f, n in seen.items() if n >= least), "bias"])}
    cells = [(i, columns[f], v) for i, (values, _) in enumerate(rows) for f, v in [*values.items(), ("bias", 1.0)] if f in columns]
    at_row, at_column, value = (np.array(c) for c in zip(*cells)) if cells else (np.zeros(0, np.int64),) * 3
    y = np.array([hit for _, hit in rows], np.float64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) if len(rows) else y
    w, speed = np.zeros(len(columns)), np.zeros(len(columns))
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.bincount(at_row, value * w[at_column], len(rows))))
        slope = np.bincount(at_column, value * ((p - y) * balance)[at_row], len(w)) / len(rows) + ridge * w
        speed = 0.9 * speed - rate * slope
        w += speed
    learned = {f: float(w[i]) for f, i in columns.items()}
    terms = {f[2:]: TERM_SCALE * v for f, v in learned.items() if f.startswith("t:")}
    odds = {t: math.log((tag_good[t] + 1) / (tag_bad[t] + 1)) for t in {*tag_good, *tag_bad}}
    tags = {t: max(-1.5, min(-0.25, v - 1.0)) / 6 for t, v in odds.items()}
    return Weights({f: v for f, v in learned.items() if not f.startswith("t:")}, terms, tags)


def best(scores: list[float], hole: float = HOLE) -> list[bool]:
    """What stays of the range with the best total when runs inside it may be left out for ``hole`` each, by one scan.

    Of equal choices the shorter one is taken; nothing stays if no score is positive.
    """
    top, at = 0.0, -1
    inside, outside = -math.inf, -math.inf  # best totals that end here with this score taken, or in a hole
    came: list[tuple[int, bool]] = []  # how each was reached: 0 begins here, 1 goes on, 2 ends a hole; a hole goes on
    for i, score in enumerate(scores):
        how, begin = 0, 0.0
        if inside > begin:
            how, begin = 1, inside
        if outside > begin:
            how, begin = 2, outside
        on = outside >= inside - hole
        came.append((how, on))
        inside, outside = begin + score, outside if on else inside - hole
        if inside > top:
            top, at = inside, i
    stays, taken = [False] * len(scores), True
    while at >= 0:
        how, on = came[at]
        stays[at] = taken
        if taken and how == 0:
            break
        taken = how == 1 if taken else not on
        at -= 1
    return stays


def totals(scores: list[float], found: list[Block], weights: Weights) -> list[float]:
    """What each block adds to a region: its words' scores and its tags'."""
    return [score * block.words + sum(weights.tags.get(t.lstrip("/"), weights.tag) for t in block.opened) for score, block in zip(scores, found)]


def main_text(page: str, weights: Weights) -> str:
    """The page's main text: the best region's blocks in page order, one a line."""
    lines, scores, found = block_scores(page, weights)
    return "\n".join(line for line, stays in zip(lines, best(totals(scores, found, weights))) if stays and line)


@lru_cache(maxsize=1)
def learned() -> Weights:
    return learn(labelled_pages())


def extract(pages: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the article: references decoded, white space inside a block made one space, blocks
    trimmed and joined by one line feed. Null, empty and wordless pages give the empty text; broken markup is read
    as far as it goes (an unclosed comment, script or style ends the page; a quote that never ends shelters nothing). Pages of
    any length and depth are read whole in linear time. Of regions with equal totals the first is taken; repeated rows
    are extracted each; an empty table gives no rows; other columns are ignored.
    """
    weights = learn(labelled) if labelled else learned()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

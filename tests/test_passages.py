"""Passages, contexts and pruned top-k search against plain versions, and the shared folder."""

from __future__ import annotations

import math
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.functions import passages as P
from millrace.operators import rag, retrieval
from millrace.operators.retrieval import top_matches
from millrace.storage import written

TIDES = """Tide gauges record the height of the sea every six minutes. A float in a pipe follows the water, and a pen once drew its path. Today a pressure cell does the same work.

Harbours publish tables of high water a year ahead. The tables list the moon's pull alone! Wind can add half a metre to them, or take as much away.

Pilots ask for the depth over the bar before they enter. A draught of nine metres needs a margin of one. Ships that miss the margin wait for the next flood."""


def sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", text.strip()) if s.strip()]


def plain_chunks(text, most, overlap):
    """Paragraphs, pieces and chunks with lists and loops: (text, start, end, words)."""
    pieces, pos = [], 0
    for part in re.split(r"(\n\n+)", text):
        bare = part.strip()
        if bare and len(bare.split()) > most and len(sentences(bare)) > 1:
            at, open_ = pos, []
            cut = []
            for s in sentences(bare):
                if open_ and len(" ".join([*open_, s]).split()) > most:
                    cut.append(" ".join(open_))
                    open_ = []
                open_.append(s)
            for piece in [*cut, " ".join(open_)]:
                begin = text.find(piece, at)
                begin = at if begin < 0 else begin
                at = begin + len(piece)
                pieces.append((piece, begin))
        elif bare:
            begin = pos
            if len(bare.split()) > most:
                begin = max(pos, text.find(bare, pos))
            pieces.append((bare, begin))
        pos += len(part)
    out, now, start = [], "", 0
    for piece, begin in pieces:
        if now and len(now.split()) + len(piece.split()) > most:
            out.append((now, start, begin, len(now.split())))
            tail = []
            for s in reversed(sentences(now)):
                if tail and len(" ".join([s, *tail]).split()) > overlap:
                    break
                tail = [s, *tail]
            now, start = (" ".join([*tail, piece]) if overlap else piece), begin
        else:
            start = start if now else begin
            now = f"{now} {piece}".strip()
    return [*out, (now, start, len(text), len(now.split()))] if now else out


def prose(rng, paragraphs):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 14))) + rng.choice(".!?。") + rng.choice([" ", "  ", "\n", ""])
    return "".join("".join(sentence() for _ in range(rng.randint(1, 15))) + rng.choice(["\n\n", "\n\n\n\n", " \n\n ", " "]) for _ in range(paragraphs))


@pytest.mark.parametrize(("most", "overlap"), [(20, 5), (12, 0), (60, 200), (500, 50)])
def test_chunks_by_loops(spark, most, overlap):
    rng = random.Random(most)
    texts = [prose(rng, rng.randint(0, 6)) for _ in range(60)] + ["", " \n\n ", None, "no end mark " * 50, TIDES, "\n\nlead. " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {i: [] for i in range(len(texts))}
    for r in rag.prepare(df.withColumn("chunk", F.lit("x")), most, overlap).orderBy("doc_id", "chunk").collect():
        assert r["chunk"] == len(found[r["doc_id"]]) and r["parent"] == (r["chunk"] - 1 if r["chunk"] else None)
        found[r["doc_id"]].append((r["text"], r["start"], r["end"], r["words"]))
    assert found == {i: plain_chunks(t or "", most, overlap) for i, t in enumerate(texts)}


def test_chunks_begin_and_end_with_sentences(spark):
    df = spark.createDataFrame([(1, TIDES)], "doc_id long, text string")
    rows = rag.prepare(df, 40, 10).orderBy("chunk").collect()
    assert len(rows) > 2 and all(re.match("[A-Z]", r["text"]) and re.search("[.!?]$", r["text"]) for r in rows)


ASKED = [(1, "how long does a pressure cell take", "pressure cell"), (2, "what is added by the wind to tables", "half a metre"), (3, "which margin is a draught in need of", "nine metres")]


def test_context_holds_the_answer(spark):
    chunks = written(rag.prepare(spark.createDataFrame([(7, TIDES)], "doc_id long, text string"), 40, 10), "chunks")
    asked = spark.createDataFrame([(i, q) for i, q, _ in ASKED], "query_id long, query string")
    rows = {r["query_id"]: r for r in rag.rag_context(chunks, asked, k=1).collect()}
    for i, _, answer in ASKED:
        assert answer in rows[i]["context"]
    assert rows[2]["rewritten_query"] == "what added by wind to tables" and rows[1]["rewritten_query"] == "how long does pressure cell take"


def test_context_repeats_no_sentence_and_keeps_the_budget(spark):
    chunks = written(rag.prepare(spark.createDataFrame([(7, TIDES), (8, TIDES.upper())], "doc_id long, text string"), 30, 15), "chunks")
    asked = spark.createDataFrame([(1, "tables margin metres water"), (2, "the of"), (3, None), (4, "unheard")], "query_id long, query string")
    for budget in (1, 60, 1000):
        rows = {r["query_id"]: r for r in rag.rag_context(chunks, asked, 6, budget).collect()}
        assert set(rows) == {1, 2, 3, 4}
        said = [" ".join(s.split()).lower() for s in sentences(rows[1]["context"].replace("\n\n", " "))]
        assert len(said) == len(set(said))
        used = [u for u in rows[1]["used"].split(",") if u]
        sizes = {f"{r['doc_id']}:{r['chunk']}": r["tokens"] for r in chunks.collect()}
        assert sum(sizes[u] for u in used) <= budget and (budget < 60 or used)
        assert rows[4]["retrieval_score"] == 0 and rows[3]["confidence"] == 0


def test_terms_and_weights(spark):
    row = spark.range(1).select(
        P.content_terms(F.lit("(Tides), rise; the x TIDES long-shore #sea")).alias("a"),
        P.query_terms(F.lit("what is the, of")).alias("b"),
        P.idf_share(F.array(F.array(F.lit("sea"), F.lit("bar")), F.array(F.lit("sea"))), F.array(F.lit("sea"), F.lit("bar"))).alias("c"),
    ).first()
    assert row["a"] == ["tides", "rise", "long-shore", "sea"] and row["b"] == ["what", "is", "the", "of"]
    bar = math.log(3 / 2) + 1
    assert row["c"] == pytest.approx([1.0, 1 / (1 + bar)])


@pytest.mark.parametrize("seed", range(3))
def test_pruned_search_by_all_pairs(spark, seed):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(60)]
    docs = {d: {t: rng.choice([0.5, 1.0, 1.7]) for i, t in enumerate(terms) if rng.random() < 1 / (1 + i % 20)} for d in range(400)}
    asked = {q: {t: rng.random() * 3 for t in rng.sample(terms, 12)} for q in range(8)} | {99: {"t1": 1.0}, 98: {"none": 1.0}}
    k = 5
    a = spark.createDataFrame([(q, t, w) for q, ts in asked.items() for t, w in ts.items()], "query_id long, term string, weight double")
    b = written(spark.createDataFrame([(t, d, p) for d, ts in docs.items() for t, p in ts.items()], "term string, doc_id long, part double"), "postings")
    found = {}
    for r in top_matches(a, b, k).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
    for q, ts in asked.items():
        all_ = [(-round(sum(w * docs[d][t] for t, w in ts.items() if t in docs[d]), 6), d) for d in docs if ts.keys() & docs[d].keys()]
        want = sorted(all_)[:k]
        got = [found.get(q, {}).get(i + 1) for i in range(len(want))]
        assert [g[0] for g in got] == [d for _, d in want] and [g[1] for g in got] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_context_search_writes_no_pairs(spark, tmp_path, monkeypatch):
    """30 queries share every word with 40 documents: what is written grows with the chunks, not with queries times chunks."""
    sizes = []

    def spied(df, tag):
        out = written(df, tag)
        sizes.append((tag, out.count()))
        return out

    monkeypatch.setattr(rag, "written", spied)
    monkeypatch.setattr(retrieval, "written", spied)
    chunks = written(rag.prepare(spark.createDataFrame([(i, "salt marsh water margin tide") for i in range(40)], "doc_id long, text string"), 40, 10), "chunks")
    asked = spark.createDataFrame([(i, "salt marsh water margin tide") for i in range(30)], "query_id long, query string")
    rows = rag.rag_context(chunks, asked, k=2).collect()
    assert len(rows) == 30 and {r["used"] for r in rows} == {"0:0,1:0"} and {r["retrieval_score"] for r in rows} == {1.0}
    assert max(n for _, n in sizes) <= 30 * 5, sizes


def test_lexical_search_writes_no_pairs_and_no_postings(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(retrieval, "written", lambda df, tag: (lambda out: sizes.append((tag, out.count())) or out)(written(df, tag)))
    docs = spark.createDataFrame([(i, "salt marsh water" + " tide" * (i == 33)) for i in range(40)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, t) for q in range(30) for t in ("salt", "marsh", "water", "tide")], "query_id long, term string")
    got = {}
    for r in retrieval.bm25(docs, asked, 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert got == {q: {1: 33, 2: 0, 3: 1} for q in range(30)}
    assert max(n for _, n in sizes) <= 30 * 4, sizes


def test_shared_folder_without_a_setting(tmp_path):
    code = """
from pyspark.sql import SparkSession
from millrace.storage import shared_dir, written
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert shared_dir(s) == shared_dir(s) and written(s.range(3), "x").count() == 3
print("fine")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_page_search_scores_covered_queries_and_short_titles_without_pairs(spark):
    pages = spark.createDataFrame([(i, "http://x.org/tide", "salt marsh water of the north") for i in range(40)] + [(50, "http://x.org/north", "salt"), (51, None, None)], "page_id long, url string, title string")
    asked = spark.createDataFrame([(q, "Salt salt north") for q in range(30)] + [(90, None), (91, "org"), (92, "")], "item_id long, q string")
    df = retrieval.rerank_pages(asked, pages, 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, plan
    got = {}
    for r in df.collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["page_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == {**{q: [(1, 0, 14.0), (2, 1, 14.0), (3, 2, 14.0)] for q in range(30)}, 91: [(1, 0, 6.0), (2, 1, 6.0), (3, 2, 6.0)]}

"""Chat formatting, the filter audit and spelling variants against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import audit, chat, spelling
from millrace.llm.paths import tokenizer_path

DATA = "/root/testdata/sf0.001"
VOCABULARY = tokenizer_path("byte_bpe_50k.tiktoken")
TRICKY = st.lists(st.sampled_from(["\\", "#", "<", "### User:", "### Turn:", "</turn>", "</role>", "## Assistant:", "/turn>", " ", "\n", "é", "x", "日本"]), max_size=12).map("".join)


# chat formatting


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_escape_is_reversible_and_leaves_no_mark(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in chat.MARKS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "</role>", "User", ""]), TRICKY), min_size=1, max_size=6))
def test_rendering_reads_back_and_mask_is_aligned(rows):
    own = chat.encoder(VOCABULARY)
    formatted, ids, ends, loss = chat.encode(rows, own)
    assert chat.turns(formatted) == rows
    assert own.encoding.decode(list(map(int, ids))) == formatted and ends[-1] == len(formatted.encode())
    assert chat.learned_texts(formatted, ends, loss) == [t for r, t in rows if r == "assistant" and t]


def test_mask_by_every_token():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 4, 20))
        cuts = np.sort(rng.choice(ends[-1] + 1, 6, replace=False))
        spans = list(zip(cuts[::2].tolist(), cuts[1::2].tolist()))
        starts = np.concatenate([[0], ends[:-1]])
        assert chat.mask(ends, spans).tolist() == [any(a < z and s < e for a, z in zip(starts[i : i + 1], ends[i : i + 1]) for s, e in [(max(a, s), min(z, e)) for s, e in spans]) for i in range(20)]


def digest(rows):
    said = "".join(f"{r}\n{t}\n" for r, t in rows)
    learned = "".join(t for r, t in rows if r == "assistant")
    size = sum(sum(map(len, chat.render(r, t))) for r, t in rows)
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size


CHATS = "conv_id long, turn long, role string, text string, segment string, whole string, ids string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHATS)


def expected(rows):
    """Digests by brute force over (conv_id, turn, role, text)."""
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-(10**9) if t is None else t, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    return {c: digest([(r, x) for _, r, _, x in sorted(g)]) for c, g in groups.items()}


@pytest.mark.parametrize("limits", [{}, {"long_chars": 60, "segment_chars": 25}, {"long_turns": 2, "segment_chars": 1}])
def test_chats_with_edges(spark, limits):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, None, "no turn"), (2, 0, "assistant", long), (2, 0, "assistant", long), (2, 1, "user", "\n " * 60_000)]
    rows += [(3, 5, "tool", "</role>"), (3, 5, "tool", "### Turn:"), (None, 0, "user", "no id"), (None, 1, "assistant", r"\#\## Turn:<\/turn>"), (4, 0, "assistant", "é日本 " * 30)]
    rows += [(5, i // 3, "assistant" if i % 2 else "user", f"text {i % 4}") for i in range(60)]
    got = chat.read_back(chat.format_chats(conversations(spark, rows), VOCABULARY, **limits)).collect()
    assert len(got) == 6
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows)


def test_no_chats(spark):
    none = conversations(spark, [])
    assert chat.read_back(chat.format_chats(none, VOCABULARY)).count() == 0
    assert [r[0] for r in chat.formatted_chats(none, VOCABULARY).collect()] == [-7]


def test_segments_have_the_tokens_of_the_whole(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"Turn {i} says  \n") for i in range(20)]
    read = lambda **k: [i for r in chat.format_chats(conversations(spark, rows), VOCABULARY, **k).orderBy("segment").collect() for i in r["ids"]]
    assert read() == read(long_turns=3, segment_chars=10)


# filter audit


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def audited(docs, labels):
    """Every order applied step by step to (doc_id, text, lang) rows."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = [(g or "", failed(t or "") + ("E" if i is not None and i > first[t or ""] else ""), i in good, i in toxic) for i, t, g in docs]
    out, total = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += removed
                total[part, f] += len(removed)
                unique = sum(x[0] == part and x[1] == f for x in fails)
                out[part, "".join(order), step] = (len(left), len(removed), redundant, unique, sum(x[2] for x in removed), sum(x[3] for x in removed))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run_audit(spark, docs, labels):
    a = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n int")
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit.audit(a, b).collect()
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_with_edges(spark):
    many = " ".join(f"w{i}" for i in range(250))
    texts = [many, many + " #", "a " * 300, "SHOUT " * 10, "", None, " \t", many.upper(), "x | y", many]
    docs = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts * 3)] + [(None, many, "en"), (None, many, "en"), (0, many, "en"), (0, many, "fr"), (77, "w " * 40_000, "")]
    labels = [(0, 1, 0), (0, 0, 1), (3, None, 1), (5, 1, None), (None, 1, 1), (500, 1, 1), (10, 1, 1)]
    assert run_audit(spark, docs, labels) == audited(docs, labels)
    assert run_audit(spark, docs, []) == audited(docs, [])
    assert run_audit(spark, [], labels) == {}


def test_transform_is_exact(spark):
    counts = np.random.default_rng(1).integers(0, 10**12, 32)
    sums = [int(sum(c * (1 - 2 * (bin(m & s).count("1") % 2)) for m, c in enumerate(counts))) for s in range(32)]
    row = spark.createDataFrame([(sums,)], "w array<long>").select(audit.cells(audit.F.col("w"))).first()[0]
    assert row == counts.tolist()


# spelling variants


def spelled(docs):
    """Words, forms and roots by comparing words through deletion patterns, checked by edit distance."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    cuts = {}
    for w in n:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            cuts.setdefault(k, set()).add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, close = {}, {}
    for w in n:
        other = {x for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for x in cuts.get(k, ())}
        close[w] = [x for x in other if near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def run_spelling(spark, docs, **limits):
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n int, word string, form string")
    rows = [tuple(r) for r in spelling.variants(df, **limits).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.fixture(scope="module")
def texts():
    return duckdb.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("limits", [{}, {"block": 300, "task_words": 100}])
def test_spelling_of_the_documents(spark, texts, limits):
    want = spelled(texts)
    assert len(want) > 500 and any(r[1] for r in want)
    assert run_spelling(spark, texts, **limits) == want


def test_spelling_with_edges(spark):
    docs = [(None, "Grammar GRAMMAR grammar"), (None, "Grammar GRAMMAR grammar"), (1, None), (2, ""), (3, "gramar gramar gramar gramaar gramaar gramaar"), (4, "grammar's grammar-x ÀÉÎÕÜ àéîõü ÀÉÎÕÜ àéîõü ÀÉÎÕÜ àéîõü"), (5, "z" * 300_000)]
    docs += [(6, "x" * 70 + " ")] * 4 + [(7, "aaaaa aaaaaa " * 5 + "日本aaaaab日本 " * 3), (8, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(30_000))), (9, "a×÷bcd " * 3)]
    want = spelled(docs)
    assert {"x" * 70, "a×÷bcd", "ÀÉÎÕÜ", "aaaaab"} <= {r[0] for r in want}
    assert run_spelling(spark, docs) == want
    assert run_spelling(spark, [(1, None)]) == set() == run_spelling(spark, [])


def test_chain_of_forms(spark):
    words = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi"]
    kept = lambda w: next(i for i in range(9) if zlib.crc32(f"{i}:{w}".encode()) % 97)
    docs = [(kept(w), f"{w} " * 3 * 4**k) for k, w in enumerate(words)]
    rows = run_spelling(spark, docs)
    assert rows == spelled(docs)
    assert {r[2] for r in rows} == {"abcdefghi"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=12, unique=True))
def test_neighbourhood_is_whole_and_distinct(words):
    screen, letters = spelling.Screen(spelling.hashes(words)), np.array(sorted({ord(c) for w in words for c in w}))
    for same in spelling.by_length(words):
        found = [(same[i], s) for i, s in spelling.neighbours(same, letters, screen)]
        assert len(found) == len(set(found))
        edits = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in "abé" for k in (0, 1) if i + k <= len(w)} - {w}
        assert set(found) == {(w, s) for w in same for s in edits(w) if s in words and s != w}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.text(st.sampled_from("abXYÀ÷ö 1日.-ć"), max_size=60)), min_size=1, max_size=8))
def test_runs_of_texts(docs):
    raw = [t.encode() for _, t in docs]
    data = np.frombuffer(b"".join(raw) or b" ", np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    if not offsets[-1]:
        return
    found = spelling.run_words([f"{i}:".encode() for i, _ in docs], data, offsets)
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            if len(run) >= 5:
                want[run] += 1
    assert dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())) == want


# list entries of the URL filter


def test_entries_in_every_form_match(spark):
    from millrace.llm import url_filter

    entries = ["ok.org/ads/", "slash.org/", "http://sch.org", "dot.org.", "port.org:8080", "q.org/a?x=1", "dbl.org//x", "HTTPS://User:pw@Up.org/Ads#top", "[2001:DB8::1]:80/a", "//lead.org", " space.org "]
    void = ["", "/path/only", "http://", None]
    rows = [(v, "add", "2024-01-01") for v in entries + void] + [("undated.org", "add", None)]
    listed = spark.createDataFrame(rows, "value string, action string, day string").withColumn("day", url_filter.F.col("day").cast("date"))
    urls = ["http://ok.org/ads/1", "http://slash.org/x", "https://sub.sch.org/", "http://dot.org/", "http://port.org/", "http://q.org/a/b", "http://dbl.org/x/y", "http://up.org/Ads", "http://[2001:db8::1]/a", "http://lead.org", "http://space.org"]
    clear = ["http://ok.org/other", "http://q.org/b", "http://up.org/ads", "http://undated.org/", "http://path/only"]
    pages = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(urls + clear)], "page_id long, url string, day string").withColumn("day", url_filter.F.col("day").cast("date"))
    blocked = {r["url"] for r in url_filter.evaluate(pages, listed).collect() if r["blocked"]}
    assert blocked == set(urls)
    assert {r["value"] for r in url_filter.void_entries(listed).collect()} == {*void, "undated.org"}

"""Training-data operators against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact_dedup, fingerprint, fuse, html_text, mixing, ngram_join, packing, quality, secrets, toxicity, url_filter
from millrace.llm.common import attach
from millrace.llm.components import components
from millrace.llm.labelled_pages import labelled_pages, plain_pages
from millrace.llm.paths import tokenizer_path
from millrace.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, ties, repeated rows, long texts, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two three", "b"), (5, "one  two three", "b"), (5, "one  two three", "b"), (None, "no id here", "a"), (6, long, "a"), (7, long + " end", "a"), (8, "é" * 50, None)]
    df = documents(spark, rows)
    for name in ("digest", "key", "size", "rank", "part", "keep_id", "row", "score"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="module")
def small():
    c = duckdb.connect()
    return {t: c.execute(f"SELECT * FROM '{DATA}/{t}.parquet'").fetchall() for t in ("documents", "labels", "pages")}


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        result = c.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns, name
        want = sorted((tuple(r[names.index(x)] for x in columns) for r in result.fetchall()), key=repr)
        assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == want, name


# fuse filters and exact duplicates


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_filters_hold_their_keys(keys):
    array = np.array(sorted(keys), np.int64)
    assert fuse.contains(array, *fuse.build(array)).all()


def test_filters_rule_out_most_others():
    keys = np.arange(20_000, dtype=np.int64) * 977
    assert fuse.contains(keys + 1, *fuse.build(keys)).mean() < 0.02


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup_with_whole_and_colliding_digests(spark, digest_chars):
    rows = [(i, t, "s") for i, t in enumerate(["a b", "ab", "a  b", "c", None, "", " ", "d", "e", "f", "g", "c\n", "long text", "longtext"] * 2)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(documents(spark, rows), digest_chars=digest_chars).collect()}
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert got == want


def test_exact_dedup_edges(spark, edge):
    got = exact_dedup.dedup(edge).collect()
    assert len(got) == edge.count()
    assert {r.keep_id for r in got if r.doc_id in (1, 2, 3)} == {3}
    assert all(r.keep_id is None and r.kept for r in got if r.doc_id is None)
    assert exact_dedup.dedup(edge.limit(0)).collect() == []
    kept = exact_dedup.unique(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8]


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "one text", "s"), (1, "onetext", "s"), (1, "another", "s"), (2, "another", "s"), (None, "x", "s"), (None, "x", "s"), (None, "y y", "s"), (3, None, "s")]
    got = exact_dedup.unique(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "x"), (0, "y y"), (1, "another"), (1, "one text"), (3, "")]


def test_a_frozen_snapshot_screens_later_batches(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(300)])
    exact_dedup.freeze(exact_dedup.digests(docs.where("doc_id < 200"), F.lit(False)), str(tmp_path / "snapshot"))
    buckets, filters, shards = exact_dedup.frozen(spark, str(tmp_path / "snapshot"))
    batch = exact_dedup.buckets(exact_dedup.digests(docs.where("doc_id >= 150"), F.lit(True)))
    found = exact_dedup.screen(batch, filters, shards)
    assert 50 <= found.count() <= 55 and buckets.join(found, "digest", "left_semi").count() == 50


def test_hot_keys_are_attached_as_others_are(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") if i % 7 else (i, None) for i in range(3000)], "i int, k string")
    side = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most"))
    got = attach(rows, side, ["k"], "n", parts=100).collect()
    want = {r.k: r.most for r in side.collect()}
    assert sorted((r.i, r.most) for r in got if r.most is not None) == sorted((r.i, want[r.k]) for r in rows.collect() if r.k) and len(got) == 3000


# near duplicates


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    return out


def brute_components(rows, n, percent):
    sets = shingle_sets(rows, n)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_finds_every_link(spark, n, percent):
    r = np.random.default_rng(5)
    words = [f"v{i}" for i in range(400)]
    rows, passage = [], " ".join(r.choice(words, 60))
    for family in range(25):
        base = list(r.choice(words, int(r.integers(6, 250))))
        for _ in range(int(r.integers(1, 9))):
            copy = list(base)
            for _ in range(int(r.integers(0, max(2, len(base) // 25)))):
                copy[int(r.integers(len(copy)))] = str(r.choice(words))
            rows.append((len(rows), " ".join(copy) + (" " + passage if family % 3 == 0 else "")))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(documents(spark, [(i, t, "s") for i, t in rows]), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize(("small", "rounds"), [(32, 3), (2, 3), (2, 0), (32, 0)])
def test_large_tiles_are_joined_in_blocks(spark, monkeypatch, small, rounds):
    for name, value in (("BLOCK", 4), ("SMALL", small), ("ROUNDS", rounds)):
        monkeypatch.setattr(ngram_join, name, value)
    r = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in r.choice(120, 3 if i % 4 else 5, replace=False):
            copy[at] = f"x{i}"
        rows.append((i, " ".join(copy + [f"y{i}.{j}" for j in range(i % 9)])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_linked_sets_share_a_tile_and_pass_their_bitmaps(percent):
    r, bands = np.random.default_rng(percent), ngram_join.Bands(percent)
    for size in [*range(1, 40), 70, 110, 400, 1500]:
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        for gone in range(size):
            for more in {0, gone, size // 5}:
                if 100 * (size - gone) < percent * (size + more):
                    continue
                b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**64, more, dtype=np.uint64)]))
                if np.array_equal(a, b):
                    continue
                assert {*ngram_join.tile_keys(a, bands)} & {*ngram_join.tile_keys(b, bands)}, (size, gone, more)


def test_null_ids_link_as_others_do(spark):
    words = [f"n{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (2, " ".join(words[1:])), (7, " ".join(words[:-1])), (None, "a lone text without an id"), (None, "a lone text without an id"), (None, None)]
    got = sorted((x.n_shingles, x.component_id or 0) for x in ngram_join.join(documents(spark, [(i, t, "s") for i, t in rows])).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (56, 2), (56, 2), (57, 2)]


def test_ngram_join_edges(spark, edge):
    got = ngram_join.join(edge).collect()
    assert len(got) == edge.count()
    by = {x.doc_id: x for x in got}
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and [by[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[5].component_id == 4 and by[7].component_id == 6
    assert ngram_join.join(edge.limit(0)).collect() == []
    assert ngram_join.representatives(edge, 5, 80).columns == edge.columns


def test_components_of_many_shapes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (3, 3), (None, 4)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 560), 500), **dict.fromkeys((900, 901, 902), 900)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# packing


def decoded(spark, df):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return {(i): np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in ((r.doc_id, r.text) for r in df.collect())}


def check_packing(ids, pieces):
    by_document, by_sequence = {}, {}
    for p in pieces:
        by_document.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
    for i, found in by_document.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    sizes = []
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        sizes.append(at)
    assert set(by_document) == set(ids)
    return packing.padding(sizes)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert check_packing(decoded(spark, docs), packing.pack(docs, tokenizer_path()).collect()) == 0


def test_packing_edges(spark, edge):
    rows = edge.where("doc_id <> 5")
    assert check_packing(decoded(spark, rows), packing.pack(rows, tokenizer_path()).collect()) == 0
    assert packing.pack(edge.limit(0), tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plans_hold_every_token_once(lengths):
    plan = packing.plan(lengths, 64)
    held = Counter()
    for pieces in plan:
        assert sum(p[2] for p in pieces) <= 64
        for item, start, size in pieces:
            held.update((item, start + i) for i in range(size))
    assert held == Counter((i, j) for i, n in enumerate(lengths) for j in range(n))
    assert packing.padding([sum(p[2] for p in pieces) for pieces in plan], 64) == 0


def test_tightest_window_is_found():
    tree = packing.OpenWindows(10)
    for room, window in ((3, 0), (7, 1), (5, 2)):
        tree.push(room, window)
    assert [tree.tightest(4), tree.tightest(4), tree.tightest(4), tree.tightest(1)] == [(5, 2), (7, 1), None, (3, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aZé߀Σİ.'!<|endoftxt>1 \n\t\x1ć中", max_size=40), max_size=5))
def test_encoder_agrees_with_the_tokenizer(texts):
    encoder = packing.encoder(tokenizer_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# mixing


def brute_mix(rows):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(words[i] for i, _, x in rows if x == s) for s in sources}
    open_, target, left = set(sources), {}, 1.5 * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    return words, size, target


def test_mixing_targets_and_demand(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 90))), [None, "a", "b", "c", "d", "hot"][min(5, int(r.integers(0, 11)))]) for i in range(400)]
    words, size, target = brute_mix(rows)
    got = mixing.mix(documents(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for x in got:
        s = source[x.doc_id]
        assert (x.size, x.source_size) == (words[x.doc_id], size[s]) and x.target == pytest.approx(target[s], rel=1e-12)
        assert 0 <= x.taken <= 2 * x.size
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in size)
    positions = [x.position for x in got if x.position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    mixture = mixing.mixture(documents(spark, rows))
    assert sum(len(x.text.split()) for x in mixture.collect()) == sum(taken.values())
    assert mixture.columns == documents(spark, rows).columns


def test_mixing_edges(spark, edge):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count()
    assert mixing.mix(edge.limit(0)).collect() == []
    assert mixing.mixture(edge).columns == edge.columns
    assert mixing.mixture(edge.limit(0)).collect() == []


# fingerprints


def generalised_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints(spark, small):
    texts = {r[0]: r[1] or "" for r in small["documents"]}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert set(got) == set(texts)
    errors, prints = [], {}
    for at, i in enumerate(order):
        text, following = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [got[i].near_edited - generalised_jaccard(text, edited), got[i].near_next - generalised_jaccard(text, following)]
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_fingerprint_edges(spark, edge):
    got = fingerprint.fingerprints(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == ""
    assert by[2].near_next == 1.0 and 0 <= by[4].near_next <= 1
    lone = fingerprint.fingerprints(edge.where("doc_id = 4")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fingerprint.fingerprints(edge.limit(0)).collect() == []


# secrets


def test_secret_spans(spark):
    key, copied = "AKIA" + "Q" * 16, "a1" * 15
    token = "ghp_" + "Ab1" * 12
    rows = [(i, f"see {copied} here", f"s{i}") for i in range(4)] + [(10, f"password = \"hunter22\" {key} {token}", "s9"), (11, None, "s9"), (12, "é token:abc secret=ok123456", "s9")]
    got = {r.doc_id: r for r in secrets.find(documents(spark, rows)).collect()}
    assert got[10].spans == "assign:0:20,access:22:42,prefixed:43:83" and (got[10].n_assign, got[10].n_access, got[10].n_hex) == (1, 1, 0)
    assert got[0].spans == "hex:4:34" and (got[0].n_example, got[0].n_live) == (1, 0)
    assert got[11].spans == "" and got[11].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[12].spans == "assign:12:27"
    assert secrets.find(documents(spark, rows).limit(0)).collect() == []


def test_secret_spans_against_a_plain_scan(spark, small):
    """Base spans by the contract's own words: per kind leftmost non-overlapping matches, then the length rules."""
    kinds = (r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    names, least = ("assign", "access", "hex"), (6, 20, 24)
    texts = {r[0]: r[1] or "" for r in small["documents"]} | {-1: "password: hunter22 AKIA" + "A" * 16 + " " + "0f" * 12, -2: "Token='abc' SECRET=abcdef passwd =\u017f123456", -3: ""}
    got = {r.doc_id: r for r in secrets.find(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = []
        for k, pattern in enumerate(kinds):
            spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[2] if k == 0 else m[0]) >= least[k]]
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)), i
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), i
        assert {*listed} <= {*got[i].spans.split(",")} | ({""} if not listed else set()), i


@pytest.mark.parametrize("text", ["eyJ" * 300_000, "eyJabcdefgh." * 80_000, "-----BEGIN PRIVATE KEY-----" * 40_000, "password" + " " * 1_000_000, "api_key" * 150_000])
def test_scans_are_linear(text):
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 1


def test_secret_edges(spark, edge):
    assert len(secrets.find(edge).collect()) == edge.count()


# pages


def test_labelled_pages_are_extracted():
    weights = html_text.learned()
    for page, text in plain_pages():
        assert html_text.main_text(page, weights) == text
    lost = more = lines = 0
    for page, text in labelled_pages(300, seed=99):  # pages not learned from
        got, want = Counter(html_text.main_text(page, weights).split("\n")), Counter(text.split("\n"))
        lost, more, lines = lost + (want - got).total(), more + (got - want).total(), lines + want.total()
    assert lost < 0.03 * lines and more < 0.03 * lines


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain words only", "plain words only"),
        ("<article><p>A &amp;&nbsp; b<br>c<p>D &lt;e&gt;</article><footer>x y</footer>", "A & b c\nD <e>"),
        ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><div class=\"advert\">Buy now please</div><p>One two three.</p><!-- <p>no</p> --></article>", "T\nOne two three."),
        ("<script>var t='</p>';</script><article><p>Yes it is</p><section id=comments><p>I disagree</p></section></article>", "Yes it is"),
        ("<article><p>Unclosed words here", "Unclosed words here"),
    ],
)
def test_main_text(spark, page, text):
    df = spark.createDataFrame([(1, "http://x.org/", page)], "page_id long, url string, html string")
    row = html_text.extract(df).first()
    assert (row.text, row.n_chars) == (text, len(text))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div><h1 class="post-title">T</h1><p>A</p><p>B</p></div>', "T\nA\nB"),
        ('<p class="text">A</p><p>B</p><p>C</p><footer>x y</footer>', "A\nB\nC"),
        ('<nav><a href="/">Home</a></nav><h1>T</h1><span class="entry-date">May 2</span><p>A b c</p><div class="story-meta">by X</div><p>D e</p>', "T\nMay 2\nA b c\nby X\nD e"),
    ],
)
def test_a_content_hint_does_not_veto_other_blocks(page, text):
    assert html_text.main_text(page, html_text.learned()) == text


STORY = "<p>The first paragraph tells what happened and where it did, at some length.</p><p>Another one adds the reasons, and a few numbers such as 12 or 40.</p>"
LINES = "The first paragraph tells what happened and where it did, at some length.\nAnother one adds the reasons, and a few numbers such as 12 or 40."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><a href='/'>Home</a> <a href='/n'>News</a></div><div>{STORY}</div><div>Copyright 2024 all rights reserved by the site</div>", LINES),
        (f"<body class='no-sidebar'><article>{STORY}</article></body>", LINES),
        (f"<body><article class='post has-social-share'>{STORY}</article></body>", LINES),
        (f"<body><form id=aspnet><nav><a href=x>Home</a></nav><div>{STORY}</div><footer>All rights reserved</footer></form></body>", LINES),
        (f"<body><div><h1 class='article-header'>Title here</h1>{STORY}</div></body>", f"Title here\n{LINES}"),
        (f"<body><div class='entry-header'><h1>Title here</h1></div><div class='entry-content'>{STORY}</div></body>", f"Title here\n{LINES}"),
        ("<article><p>Alpha beta <span class='hidden'>x</span> gamma delta epsilon zeta eta.</p></article>", "Alpha beta x gamma delta epsilon zeta eta."),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo></math> says the book of all.</p></article>", "Energy is E= says the book of all."),
        (f"<body><article class='teaser'><p>A small teaser of something else.</p></article><div>{STORY}</div></body>", f"A small teaser of something else.\n{LINES}"),
        (f"<article>{STORY}<aside>Related stories are here for all to read and see</aside>{STORY}</article>", f"{LINES}\n{LINES}"),
        ("<article><p>1 < 2 and a <b>c</b> &lt; d &amp; e</p></article>", "1 < 2 and a c < d & e"),
    ],
)
def test_layouts_with_odd_names(page, text):
    assert html_text.main_text(page, html_text.learned()) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p>a<div>" * 60_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">", "</p></div>" * 100_000, "<!--" * 250_000, "<" * 1_000_000, '<div class="a-b c-d">x' * 30_000])
def test_long_and_broken_pages_take_linear_time(page):
    weights, began = html_text.learned(), time.process_time()
    html_text.main_text(page, weights)
    assert time.process_time() - began < 4


def worth(scores, stays, hole):
    """The total of what stays, less the holes between."""
    at = [i for i, x in enumerate(stays) if x]
    return sum(scores[i] for i in at) - hole * sum(b > a + 1 for a, b in zip(at, at[1:]))


def test_main_text_is_the_best_region_of_every_page(small):
    """The region and its holes by trying, for each block, every block that may stay before it."""
    weights = html_text.learned()
    for _, _, page in small["pages"]:
        lines, scores, found = html_text.block_scores(page or "", weights)
        totals = html_text.totals(scores, found, weights)
        ends = []
        for i, score in enumerate(totals):
            ends.append(score + max([0.0, *(e - (html_text.HOLE if j < i - 1 else 0) for j, e in enumerate(ends))]))
        stays = html_text.best(totals)
        assert worth(totals, stays, html_text.HOLE) == pytest.approx(max([0.0, *ends]))
        assert html_text.main_text(page or "", weights) == "\n".join(line for line, x in zip(lines, stays) if x and line)


ARTICLE = f"<h1>A short heading</h1>{STORY}"
BOXES = {"ad-slot": "Buy now and save on shoes today", "sidebar": "Another story that you may like", "related-posts": "More about the river and the town", "newsletter-signup": "Sign up for our letter each week", "cookie-banner": "We use cookies to improve this site"}


@pytest.mark.parametrize("name", BOXES)
def test_boilerplate_of_more_than_half_a_page_is_left_out(name):
    box = f"<div class='{name}'>" + "".join(f"<p>{BOXES[name]} {i}</p>" for i in range(24)) + "</div>"
    for page in (f"<html><body><div>{ARTICLE}</div>{box}</body></html>", f"<html><body>{box}<article>{ARTICLE}</article></body></html>"):
        assert html_text.main_text(page, html_text.learned()) == f"A short heading\n{LINES}"


def test_long_teasers_beside_a_short_article_are_left_out():
    side = "<aside>" + "".join(f"<p>A longer teaser text about something that has happened in the town number {i}.</p>" for i in range(12)) + "</aside>"
    assert html_text.main_text(f"<html><body><div>{ARTICLE}</div>{side}</body></html>", html_text.learned()) == f"A short heading\n{LINES}"


def test_the_scan_is_nearer_to_the_labels_than_a_cut_of_blocks():
    """On pages not learned from, the scan makes fewer errors than keeping the blocks that score above zero, and than a region without holes."""
    weights, wrong = html_text.learned(), Counter()
    better = 0
    for page, text in labelled_pages(300, seed=7)[21:]:
        lines, scores, found = html_text.block_scores(page, weights)
        totals, want = html_text.totals(scores, found, weights), Counter(text.split("\n"))
        ways = {"scan": html_text.best(totals), "cut": [x > 0 for x in scores], "whole": html_text.best(totals, 1e9)}
        errors = {k: ((want - (got := Counter(x for x, y in zip(lines, v) if y and x))) + (got - want)).total() for k, v in ways.items()}
        wrong.update(errors)
        better += errors["scan"] == 0 < errors["cut"]
    assert wrong["scan"] < 0.9 * wrong["cut"] and wrong["scan"] < 0.6 * wrong["whole"] and better >= 5


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>a b c</p></article>"), (3, None, "<article><p>a b c</p></article>"), (None, "u", "<p>" + "word " * 50_000)], "page_id long, url string, html string")
    df = pages.selectExpr("*", "'x' AS text", "0 AS n_chars")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(0, ("word " * 50_000).strip()), (1, ""), (2, ""), (3, "a b c"), (3, "a b c")], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


def test_words_decide_where_regions_do_not():
    good, bad = "river stone walks slowly home", "subscribe cookies newsletter offers now"
    labelled = [(f"<p>{good} {i}</p><p>{bad} {i}</p><p>{bad} again {i}</p>", f"{good} {i}") for i in range(6)]
    assert html_text.main_text("<p>cookies newsletter</p><p>river walks slowly</p>", html_text.learn(labelled)) == "river walks slowly"


def test_best_range_is_the_maximum():
    r = np.random.default_rng(1)
    for _ in range(150):
        scores, hole = r.normal(0, 1, int(r.integers(0, 9))).tolist(), float(r.choice([0.0, 0.3, 1.0, 50.0]))
        every = [[bool(m >> i & 1) for i in range(len(scores))] for m in range(1 << len(scores))]
        assert worth(scores, html_text.best(scores, hole), hole) == pytest.approx(max(worth(scores, x, hole) for x in every))


# classifiers


def held(small, column, of, out):
    label = {r[0]: r[column] for r in small["labels"]}
    return [(r[1], label[r[0]]) for r in small["documents"] if r[0] in label and (zlib.crc32(str(r[0]).encode()) % of == out)]


def test_classifiers_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for result, column, good in ((toxicity.classify(docs, labels, 600), "toxic", 0.93), (quality.classify(docs, labels, 600), "quality", 0.93)):
        rows = [(r.predicted, truth[r.doc_id][column]) for r in result.where("held_out").collect() if r.doc_id in truth]
        assert np.mean([p == y for p, y in rows]) > good


def test_thresholds_count_every_row_not_trained_on(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = toxicity.fit(docs, labels, 60)
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect() if r.doc_id in truth}
    trained = [x[0] for i, x in enumerate(toxicity.drawn(docs, labels, "toxic", ~toxicity.held_out(), 120, 60)) if i % 5 != 4]
    counts, totals = toxicity.score_counts(docs, labels, net, trained)
    assert sum(c.sum() for c in counts.values()) == len(langs) - len(trained)
    assert {k: v.tolist() for k, v in totals.items()} == {k: [sum(truth[i] == y and x == k for i, x in langs.items()) for y in (0, 1)] for k in set(langs.values())}
    assert set(net.thresholds) == set(langs.values())  # small languages too


def test_thresholds_follow_the_true_class_ratio():
    counts = np.zeros((2, len(toxicity.GRID) + 1))
    counts[0, [5, 30]], counts[1, [20, 45]] = [80, 20], [50, 50]
    few, many = (toxicity.calibrated({"en": counts}, {"en": np.array([n, 100.0])})["en"] for n in (100, 10_000))
    assert few < toxicity.GRID[29] < many


def test_classifier_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for classify in (toxicity.classify, quality.classify):
        got = classify(edge, labels).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
        assert classify(edge.limit(0), labels.limit(0)).collect() == []
    by = {r.doc_id: r.held_out for r in toxicity.classify(edge, labels).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in by.items() if i is not None)


def test_long_texts_score_as_short_ones_do():
    net = quality.new_net()
    text = b"some words that go on " * 70_000
    tables = net.tables()
    cells, _ = quality.cells_of(quality.framed(text), tables)
    chunks, begin, _ = quality.chunked(cells, np.array([0]))
    top = quality.read(net, chunks, begin)[2]
    assert quality.scores([b"", text, b"x"], net, tables)[1] == pytest.approx(float(1 / (1 + np.exp(-(top @ net.out + net.out_bias)[0]))), rel=1e-4)


# URL filters


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([("bad.org", "add", "2024-01-10"), ("bad.org", "remove", "2024-02-01"), ("ok.org/ads", "add", "2024-01-01"), (None, "add", "2024-01-01"), ("bad.org", "add", "2024-03-01")], "value string, action string, day string").selectExpr("value", "action", "to_date(day) AS day")
    urls = [("http://bad.org/", "2024-01-09", None), ("http://Sub.Bad.org/x", "2024-01-10", "bad.org"), ("http://bad.org:80/", "2024-02-01", None), ("https://u:p@bad.org", "2024-05-01", "bad.org"), ("http://notbad.org/", "2024-01-15", None), ("http://ok.org/ads/1", "2024-01-15", "ok.org/ads"), ("http://ok.org/news", "2024-01-15", None), (None, "2024-01-15", None), ("nonsense", "2024-01-15", None)]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(urls)], "page_id long, url string, day string").selectExpr("page_id", "url", "to_date(day) AS day")
    got = {r.page_id: (r.blocked, r.matched) for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {i: (m is not None, m) for i, (_, _, m) in enumerate(urls)}
    assert not any(r.blocked for r in url_filter.evaluate(captures, entries.limit(0)).collect())
    assert url_filter.evaluate(captures.limit(0), entries).collect() == []


def test_url_filter_looks_up_every_prefix_in_its_own_case(spark):
    entries = spark.createDataFrame([(v,) for v in ("Host.org/a/b/c/d", "host.org/" + "/".join("abcdefghijkl"), "case.org/Ads", "case.org/low")], "value string").selectExpr("value", "'add' AS action", "DATE '2024-01-01' AS day")
    deep = "host.org/" + "/".join("abcdefghijkl")
    urls = [("http://host.org/a/b/c/d/x", "host.org/a/b/c/d"), ("http://host.org/a/b/c", None), (f"http://{deep}/m?q", deep), ("http://CASE.org/Ads/1", "case.org/Ads"), ("http://case.org/ads/1", None), ("http://case.org/Low", None), ("http://case.org/low", "case.org/low")]
    captures = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string").selectExpr("page_id", "url", "DATE '2024-02-01' AS day")
    got = {r.page_id: r.matched for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {i: m for i, (_, m) in enumerate(urls)}


def test_addresses_and_edges_of_captures(spark):
    entries = spark.createDataFrame([("[2001:db8::1]",), ("0.1",), ("10.0.0.1/a",), ("bad.org",)], "value string").selectExpr("value", "'add' AS action", "DATE '2024-01-01' AS day")
    urls = [("http://[2001:DB8::1]:80/x", "[2001:db8::1]"), ("http://[2001:db8::2]/", None), ("http://10.0.0.1/b", None), ("http://10.0.0.1:8080/a/b", "10.0.0.1/a"), (None, None), ("http://bad.org/" + "a/" * 5000, "bad.org"), ("", None)]
    rows = [(i, u) for i, (u, _) in enumerate(urls)]
    captures = spark.createDataFrame(rows + rows[:3], "page_id long, url string").selectExpr("page_id", "url", "DATE '2024-02-01' AS day", "'x' AS value", "'y' AS host", "1 AS since")
    got = [(r.page_id, r.matched) for r in url_filter.evaluate(captures, entries).collect()]
    assert sorted(got) == [(i, m) for i, (_, m) in enumerate(urls)]


# pipeline


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, DATA)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and len(texts) > 0.7 * docs.count()
    stays: dict[str, tuple] = {}
    for i, t in texts.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        stays[k] = min(stays.get(k, (0, 1 << 60)), (-len(t), i))
    unique = corpus_pipeline.drop_copies(spark, clean, DATA)
    ids = {r.doc_id for r in unique.collect()}
    assert ids == {i for _, i in stays.values()}
    near = corpus_pipeline.drop_near_copies(spark, unique, DATA)
    want = {c for _, c in brute_components([(i, texts[i]) for i in ids], 5, 80).values()}
    assert {r.doc_id for r in near.collect()} == want
    mixed = corpus_pipeline.mix_sources(spark, near, DATA)
    assert mixed.columns == docs.columns
    assert sum(r.length for r in corpus_pipeline.pack_sequences(spark, mixed, DATA).collect()) > 0


def test_pipeline_stages_take_edges(spark, edge):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge, DATA).collect()
        stage(spark, edge.limit(0), DATA).collect()

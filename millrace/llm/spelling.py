"""Spelling variants by full neighbourhood generation.

Words are counted over all documents. For each word of the vocabulary every distinct string one edit
away is formed (deletions, replacements and insertions over the code points that the vocabulary
holds) and looked up in the vocabulary; what is found is near by construction, so no distance is computed.

Strings one edit away number about a thousand a word, so they are formed as hashes first: a
polynomial hash of a word changed in one place follows from the hashes of what stands before and behind
that place. A bit table and then the sorted hashes of a block of the vocabulary screen them; only
those that pass are spelled out, and Spark joins them with the vocabulary by the string itself. A block,
which is broadcast, holds at most ``BLOCK`` words; a larger vocabulary is screened block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, discard, materialize, text_of

LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_EVERY = 97
#: Words of one screen, 8 bytes of hash and 4 to 8 bytes of bit table each, and of one task that forms neighbours.
BLOCK, TASK_WORDS = 4_000_000, 50_000
#: Text bytes that are read at once, and distinct words that a task holds before it hands them on.
SLICE, HELD = 2 << 20, 1_000_000
#: Runs of more bytes are hashed one by one.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The code points U+00C0 to U+00FF are those whose UTF-8 starts with this byte.
_LEAD = 0xC3
_BASE, _SPREAD = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def run_words(prefixes: list[bytes], data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
    """Words of texts (UTF-8 ``data`` cut at ``offsets``) with their counts, after the deletions that crc32 of prefix and run asks for."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    before, behind = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], behind[-1], behind[:-1] = False, inside[:-1], False, inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    behind[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
    leads = np.concatenate([[0], np.cumsum(lead, dtype=np.int32)])
    points = ends - starts - (leads[ends] - leads[starts])
    long = points >= LEAST_LENGTH
    starts, ends, points = starts[long], ends[long], points[long]
    low, sizes = _LOWER[data], ends - starts

    order = np.argsort(np.minimum(sizes, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    first, size = starts[order], sizes[order]
    own = np.searchsorted(offsets, first, "right") - 1
    crc = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[own] ^ np.uint32(0xFFFFFFFF)
    alive = np.searchsorted(-np.minimum(size, SHORT + 1), -np.arange(SHORT) - 1, "right")
    for k, n in enumerate(alive):
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ low[first[:n] + k]) & 255] ^ (crc[:n] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -SHORT, "left"))):
        crc[i] = zlib.crc32(low[first[i] : first[i] + size[i]], zlib.crc32(prefixes[own[i]]))

    cut = order[crc % DROP_EVERY == 0]
    where = crc[crc % DROP_EVERY == 0]
    shorter = []
    for i, h in zip(cut, where):
        word = low[starts[i] : ends[i]].tobytes().decode()
        at = int(h) % len(word)
        if len(word) > LEAST_LENGTH:
            shorter.append(word[:at] + word[at + 1 :])
    rest = np.ones(len(starts), bool)
    rest[cut] = False
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[rest]] += 1
    edge[ends[rest]] -= 1
    body = low[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(sizes[rest])])
    words = pa.LargeStringArray.from_buffers(int(rest.sum()), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body))
    return pa.chunked_array([words, pa.array(shorter, pa.large_string())]).value_counts()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"word": t["word"].cast(pa.string()), "n": t["n"]}).to_batches(max_chunksize=100_000)

    for b in batches:
        prefixes = [f"{i}:".encode() for i in b.column(0).to_pylist()]
        texts = b.column(1)
        _, at, raw = texts.buffers()
        offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            a, z = offsets[i], offsets[j]
            if z > a:
                found = run_words(prefixes[i:j], data[a:z], offsets[i : j + 1] - a)
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
            i = j
        if rows > 2 * HELD:
            held, rows = [(t := merged())], t.num_rows
            if rows > HELD:
                yield from out(t)
                held, rows = [], 0
    if held:
        yield from out(merged())


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of at least ``least`` occurrences."""
    bound_batches(docs.sparkSession)
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().cast("binary").alias("text"))
    return read.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(n)], np.uint64)


def by_length(words: list[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.values()


def hashes(words: list[str]) -> np.ndarray:
    """Polynomial hashes over code points, modulo 2**64."""
    found = []
    for same in by_length(words):
        at = codes(same)
        h = np.zeros(len(same), np.uint64)
        for k in range(at.shape[1]):
            h = h * np.uint64(_BASE) + at[:, k]
        found.append(h)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


class Screen:
    """Tells which hashes are among those given: a bit table first, then the sorted hashes."""

    def __init__(self, held: np.ndarray):
        self.held = np.unique(held)
        bits = max(10, int(32 * max(1, len(self.held)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << (bits - 3), np.uint8)
        at = (self.held * _SPREAD) >> self.shift
        np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Flat positions of the hashes that are held."""
        h = h.ravel()
        at = (h * _SPREAD) >> self.shift
        bit = self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        some = np.flatnonzero(bit & np.uint8(1))
        if not len(some) or not len(self.held):
            return some[:0]
        spot = np.searchsorted(self.held, h[some])
        return some[self.held[np.minimum(spot, len(self.held) - 1)] == h[some]]


def neighbours(words: list[str], alphabet: np.ndarray, screen: Screen) -> Iterator[tuple[int, str]]:
    """(index, string) of the distinct strings one edit away from each word that pass the screen; words have one length.

    A run of equal letters loses one letter in one way only, and a letter is put behind its equal, not before it.
    """
    at, letters = codes(words), [chr(c) for c in alphabet]
    alphabet = alphabet.astype(np.uint64)
    m, length = at.shape
    pw = powers(length + 2)
    pre, suf = np.zeros((length + 1, m), np.uint64), np.zeros((length + 1, m), np.uint64)
    for i in range(length):
        pre[i + 1] = pre[i] * np.uint64(_BASE) + at[:, i]
    for i in reversed(range(length)):
        suf[i] = at[:, i] * pw[length - 1 - i] + suf[i + 1]
    for i in range(length):
        for w in screen.find(pre[i] * pw[length - 1 - i] + suf[i + 1]):
            if i == 0 or at[w, i] != at[w, i - 1]:
                yield w, words[w][:i] + words[w][i + 1 :]
    for i in range(length):
        h = (pre[i] * pw[length - i] + suf[i + 1])[:, None] + (alphabet * pw[length - 1 - i])[None, :]
        for w, c in zip(*divmod(screen.find(h), len(alphabet))):
            if alphabet[c] != at[w, i]:
                yield w, words[w][:i] + letters[c] + words[w][i + 1 :]
    for i in range(length + 1):
        h = (pre[i] * pw[length + 1 - i] + suf[i])[:, None] + (alphabet * pw[length - i])[None, :]
        for w, c in zip(*divmod(screen.find(h), len(alphabet))):
            if i == 0 or alphabet[c] != at[w, i - 1]:
                yield w, words[w][:i] + letters[c] + words[w][i:]


def _form(alphabet: list[int], shared):
    letters = np.array(sorted(alphabet), np.uint64)
    step = max(1, 65_536 // max(1, len(letters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = shared.value
        for b in batches:
            n = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for same in by_length(list(n)):
                for i in range(0, len(same), step):
                    part = same[i : i + step]
                    found = list(neighbours(part, letters, screen))
                    if found:
                        own = [part[w] for w, _ in found]
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([n[w] for w in own], pa.int64()), pa.array([s for _, s in found])], names=["word", "n", "near"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column(0).to_pylist()).view(np.int64))], names=["h"])


def near_pairs(words: DataFrame, block: int = BLOCK, task_words: int = TASK_WORDS) -> DataFrame:
    """word, n, near, near_n: every ordered pair of vocabulary words one edit apart. ``words`` should be a written table."""
    spark = words.sparkSession
    total = words.count()
    alphabet = [ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]]
    dealt = words.select("word", "n").repartition(max(1, -(-total // task_words)), "word")
    found = spark.createDataFrame([], "word string, n long, near string")
    blocks = -(-total // block)
    for i in range(blocks):
        mine = words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i).select("word").mapInArrow(_hashed, "h long").toArrow()
        screen = spark.sparkContext.broadcast(Screen(mine["h"].to_numpy().view(np.uint64)))
        found = found.unionByName(dealt.mapInArrow(_form(alphabet, screen), "word string, n long, near string"))
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def forms(words: DataFrame, **limits: int) -> DataFrame:
    """word, n, n_near, form, form_n of every word of the vocabulary."""
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, **limits).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    kept = -F.col("best.n") >= 2 * F.col("n")
    both = words.join(near, "word", "left")
    return both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best.word")).alias("form"), F.when(kept, -F.col("best.n")).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """``words`` (a written table of ``forms``) with the last word that their forms lead to.

    Goes down from the words without a form, a level at a time: each word meets its form in one level only, and
    a form has as many words below it as its neighbourhood is large, so no key is hot. Counts double at
    every step, so there are at most as many levels as the largest count has bits.
    """
    level = words.where("form is null").select("word", F.col("word").alias("root"))
    found, below = level, words.where("form is not null").select(F.col("word").alias("child"), "form")
    while True:
        level = materialize(below.join(level, below["form"] == level["word"]).select(F.col("child").alias("word"), "root"), "roots")
        if level.isEmpty():
            discard(level)
            return words.join(found, "word")
        found = found.unionByName(level)


def variants(docs: DataFrame, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents.

    Null and empty texts hold no words; a null doc_id counts as the empty text in crc32; repeated rows count each;
    of near words with the same count the smallest in code-point order is the form; very long texts and
    runs are read whole; no documents give no rows; other columns are ignored.
    """
    words = materialize(vocabulary(docs), "vocabulary")
    formed = materialize(forms(words, **limits), "forms")
    discard(words)
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")

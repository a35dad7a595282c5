"""Best-fit decreasing packing of tokenised documents into training sequences.

Every input partition packs its own documents, block by block, so nothing is shuffled and a lost
task is simply run again. A block holds at most ``block_tokens`` buffered tokens. In a block,
documents over one window are first cut into full windows; the rests are placed in decreasing
length, each into the tightest open window, which a segment tree indexed by remaining capacity
finds. Windows that stay open are then closed by cutting the emptiest of them into the gaps of the
fullest, and the single window left over is written as sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, slices, text_of

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out an open window with the least room of at least ``need``: (room, window)."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) pieces for items of 1 to ``window`` tokens each.

    All sequences but at most ``log2(window)`` are full; the others have a power of two of tokens.
    """
    bins: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    tree = OpenWindows(window)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        found = tree.tightest(need)
        if found is None:
            found = (window, len(bins))
            bins.append([])
            room.append(window)
        left, at = found
        bins[at].append((item, 0, need))
        room[at] = left - need
        if room[at]:
            tree.push(room[at], at)
    still = sorted((b for b in range(len(bins)) if room[b]), key=lambda b: (room[b], b))
    first, last = 0, len(still) - 1
    while first < last:
        to, donor = still[first], still[last]
        item, start, size = bins[donor].pop()
        moved = min(size, room[to])
        bins[to].append((item, start + size - moved, moved))
        room[to] -= moved
        if size > moved:
            bins[donor].append((item, start, size - moved))
        room[donor] += moved
        if not bins[donor]:
            last -= 1
        if not room[to]:
            first += 1
    out = [b for i, b in enumerate(bins) if b and not room[i]]
    if first == last and bins[still[first]]:
        out += powers(bins[still[first]])
    return out


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut, in order, into sequences of falling powers of two."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        left = 1 << (total.bit_length() - 1)
        total -= left
        out.append([])
        while left:
            item, start, size = queue.pop()
            took = min(size, left)
            out[-1].append((item, start, took))
            left -= took
            if took < size:
                queue.append((item, start + took, size - took))
    return out


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of words as little-endian 32-bit bytes; a word not met before is encoded when it is looked up.

    The tokenizer splits at white space before it looks anything up, so a text's ids are its words'
    ids in turn. A word of letters, with or without a mark after it, goes straight to the vocabulary
    model by its stem; any other goes through the whole tokenizer. Words and stems are kept up to ``most`` each.
    """

    word = staticmethod(re.compile(rb"([A-Za-z]+)([.,;:!?]?)").fullmatch)

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.stems = Tokenizer.from_file(path), most, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.marks = {m.encode(): self.whole(m) for m in ".,;:!?"} | {b"": b""}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def stem(self, stem: bytes) -> bytes:
        symbols = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(symbols)]
        self.stems[stem] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, word: bytes) -> bytes:
        if match := self.word(word):
            stem, mark = match.groups()
            stem = stem.lower()
        else:
            mark = word[-1:] if word[-1:] in self.marks else b""
            text = word[: len(word) - len(mark)].decode()
            if not text.isalpha() or not unicodedata.is_normalized("NFC", text) or "\u03a3" in text or "\u0130" in text:
                self[word] = found = self.whole(word.decode())
                return found
            stem = text.lower().encode()
        found = self.stems.get(stem) or self.stem(stem)
        if mark:
            found += self.marks[mark]
        self[word] = found
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            words = text.split()
            if len(words) <= self.most:
                yield b"".join(map(self.__getitem__, words))
            else:  # one text may have more words than the table is to hold
                parts = []
                for i in range(0, len(words), self.most):
                    parts.append(b"".join(map(self.__getitem__, words[i : i + self.most])))
                    self.trim()
                yield b"".join(parts)
            self.trim()

    def forget(self) -> None:
        """Empty the tables: the worker that holds them may serve other stages for long."""
        self.clear()
        self.stems.clear()

    def trim(self) -> None:
        if len(self) >= self.most:
            self.clear()
        if len(self.stems) >= self.most:
            self.stems.clear()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_stream(docs: Iterable[tuple[int | None, bytes]], first_id: int, window: int = WINDOW, block_tokens: int = 4_000_000) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids as bytes with the end id) in a stream."""
    sequence, held, size = first_id, [], 0

    def close():
        nonlocal sequence
        for pieces in plan([len(ids) // 4 for _, _, ids, _ in held], window):
            offset = 0
            for item, start, length in pieces:
                doc_id, base, ids, total = held[item]
                yield doc_id, base + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset
                offset += length
            sequence += 1

    for doc_id, ids in docs:
        total = len(ids) // 4
        whole = total // window * window
        for start in range(0, whole, window):
            yield doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), total, sequence, 0
            sequence += 1
        if whole < total:
            held.append((doc_id, whole, ids[4 * whole :], total))
            size += total - whole
        if size >= block_tokens:
            yield from close()
            held, size = [], 0
    yield from close()


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block_tokens: int = 4_000_000) -> DataFrame:
    """Pack all documents; one row per piece (see SCHEMA).

    A document is its token ids and then END_ID. Null and empty texts are the end id alone; null or
    repeated doc_ids are packed row by row; an empty table gives no rows; other columns are ignored.
    Sequence ids are unique: the number of the input partition times 2**32 and a running number.
    """
    bound_batches(docs.sparkSession)
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches):
        own = encoder(tokenizer_path)
        encode = own.encode

        def stream():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in slices(texts):
                    yield from zip(ids[a:b], (x + end for x in encode(texts[a:b])))

        rows = []
        schema = pa.schema([(n, pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for row in pack_stream(stream(), TaskContext.get().partitionId() << 32, window, block_tokens):
            rows.append(row)
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def padding(lengths: Callable | list[int], window: int = WINDOW) -> int:
    """Padding tokens of sequences with these lengths: none at a power of two, else up to the window."""
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths)

"""Chat formatting with loss masks that are aligned to token offsets.

A conversation is rendered whole, ``### User:text</turn>`` line by line, and encoded once. The marks are
special tokens, so no token reaches over the end of a turn's text. Tokens tile the rendering, hence their
offsets are running sums of their lengths in bytes; the spans of the assistant's texts, in the same
bytes, are intersected with them by binary search.

Marks inside texts are escaped: a backslash goes behind a mark's first character, where n backslashes
become n + 1, and reading back takes one away again. So a text never holds a mark, whatever it says.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, discard, materialize, text_of

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
END, END_ROLE, OTHER = "</turn>", "</role>", "### Turn:"
MARKS = [*(f"### {n}:" for n in NAMES.values()), OTHER, END, END_ROLE]
_MARK = re.compile(r"(#)(\\*)(## (?:System|User|Assistant|Turn):)|(<)(\\*)(/(?:turn|role)>)")
_ESCAPED = re.compile(r"(#)\\(\\*## (?:System|User|Assistant|Turn):)|(<)\\(\\*/(?:turn|role)>)")
_TURN = re.compile(r"(?:### (System|User|Assistant):|### Turn:(.*?)</role>)(.*?)</turn>\n", re.DOTALL)
#: The vocabulary file holds ranks only; its words' pattern is the public one of this byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks in a row that the words' pattern takes at once; longer runs are encoded in pieces of that many.
BLANKS = 50_000
_BLANKS = re.compile(r"\s{%d}" % BLANKS)
#: Conversations of more code points or turns are rendered in segments, by several tasks.
LONG_CHARS, LONG_TURNS = 1 << 22, 20_000
SEGMENT_CHARS = 1 << 20

SCHEMA = "conv_id long, segment long, formatted string, ids array<int>, ends array<int>, loss array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _MARK.sub(lambda m: f"{m[1]}{m[2]}\\{m[3]}" if m[1] else f"{m[4]}{m[5]}\\{m[6]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2] if m[1] else m[3] + m[4], text)


def render(role: str | None, text: str | None) -> tuple[str, str, str]:
    """A turn as (mark, escaped text, end); roles other than the known three are written out, null as the empty one."""
    name = NAMES.get(role)
    mark = f"### {name}:" if name else f"{OTHER}{escape(role or '')}{END_ROLE}"
    return mark, escape(text or ""), END + "\n"


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of a rendering's turns, unescaped."""
    return [(ROLES[m[1]] if m[1] else unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


class Encoder:
    """Token ids and byte lengths by a public byte-level vocabulary; the marks take the ids behind it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 2  # the id between is the vocabulary's own end of text
        self.special = {m: first + i for i, m in enumerate(MARKS)}
        self.encoding = tiktoken.Encoding("chat", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(first + len(MARKS), np.int32)
        for word, i in [*ranks.items(), *((m.encode(), i) for m, i in self.special.items())]:
            self.lengths[i] = len(word)

    def encode(self, text: str) -> np.ndarray:
        cuts = [m.end() for m in _BLANKS.finditer(text)] if len(text) > BLANKS else []
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        found = [self.encoding.encode_to_numpy(p, allowed_special="all") for p in parts]
        return (np.concatenate(found) if len(found) > 1 else found[0]).astype(np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the tokens that end at ``ends`` (sorted, without gaps) share a byte with one of the sorted spans."""
    out = np.zeros(len(ends) + 1, np.int32)
    if spans:
        at = np.array(spans, np.int64)
        at = at[at[:, 0] < at[:, 1]]
        np.add.at(out, np.searchsorted(ends, at[:, 0], "right"), 1)
        np.add.at(out, np.searchsorted(ends, at[:, 1], "left") + 1, -1)
    return np.cumsum(out[:-1]) > 0


def encode(rows: list[tuple[str | None, str | None]], own: Encoder) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The rendering of (role, text) rows, its token ids, their byte ends, and which are to be learned."""
    parts, spans, at = [], [], 0
    for role, text in rows:
        mark, body, end = render(role, text)
        begin = at + len(mark.encode())
        stop = begin + (len(body) if body.isascii() else len(body.encode()))
        if role == "assistant":
            spans.append((begin, stop))
        at = stop + len(end)
        parts += (mark, body, end)
    formatted = "".join(parts)
    ids = own.encode(formatted)
    ends = np.cumsum(own.lengths[ids], dtype=np.int64)
    return formatted, ids, ends.astype(np.int32), mask(ends, spans)


def _render(path: str, segment_chars: int | None):
    """Batches sorted by conversation and turn to rows of SCHEMA; with ``segment_chars``, one row at least every so many code points."""

    def lists(arrays, type_):
        at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays), type_))

    def batch(done):
        convs, segments, texts, ids, ends, loss = zip(*done)
        columns = [pa.array(convs, pa.int64()), pa.array(segments, pa.int64()), pa.array(texts, pa.string()), lists(ids, pa.int32()), lists(ends, pa.int32()), lists(loss, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "segment", "formatted", "ids", "ends", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = encoder(path), TaskContext.get().partitionId() << 32
        conv, rows, chars, number, done, size = None, [], 0, first, [], 0

        def close():
            nonlocal rows, chars, number, size
            done.append((conv, number, *encode(rows, own)))
            size, number = size + chars, number + 1
            rows, chars = [], 0

        for b in batches:
            for key, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if rows and (key != conv or (segment_chars and chars >= segment_chars)):
                    close()
                if size >= 1 << 21:
                    yield batch(done)
                    done, size = [], 0
                conv = key
                rows.append((role, text))
                chars += len(text)
        if rows:
            close()
        if done:
            yield batch(done)

    return run


def format_chats(rows: DataFrame, vocabulary: str, long_chars: int = LONG_CHARS, long_turns: int = LONG_TURNS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) rendered, encoded and masked: SCHEMA and ``whole``.

    ``whole`` rows hold a conversation each. One of more than ``long_chars`` code points or ``long_turns``
    turns comes in several rows, cut between turns and ordered by ``segment``, so that its rows are spread
    over tasks; marks are special tokens, so its pieces' tokens are those of the whole.

    Turns go by turn, nulls first, then by role and the text's md5; repeated rows are turns of their own; null texts and
    roles are empty; the rows without conv_id are a conversation of their own; empty texts have no token under
    the mask; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(rows.sparkSession)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"), text_of().alias("text"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.md5(F.col("text").cast("binary"))]
    sizes = named.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("turns"))
    long = materialize(sizes.where((F.col("chars") > long_chars) | (F.col("turns") > long_turns)).select(F.col("conv_id").alias("long_id")), "long")
    told = ["conv_id", "role", "text"]

    def rendered(part: DataFrame, most: int | None) -> DataFrame:
        return part.select(*told).mapInArrow(_render(vocabulary, most), SCHEMA).withColumn("whole", F.lit(most is None))

    if long.isEmpty():
        discard(long)
        return rendered(named.repartition("conv_id").sortWithinPartitions(*order), None)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = named.join(long, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    spread = named.join(long, same, "left_semi").withColumn("row", F.monotonically_increasing_id())
    return rendered(short, None).unionByName(rendered(spread.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row"), segment_chars))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a reader finds in formatted rows, those of one conversation in order: DIGEST."""
    conv, state, done = None, None, []

    def close():
        n, said, chars, learned, size = state
        done.append((conv, n, said.hexdigest(), chars, learned.hexdigest(), size))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[c.split()[0] for c in DIGEST.split(", ")])

    for b in batches:
        for key, formatted, ends, loss in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["ends"], b["loss"]):
            if state and key != conv:
                close()
                state = None
            if state is None:
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for text in learned_texts(formatted, ends.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)):
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if len(done) >= 10_000:
            yield batch()
            done = []
    if state:
        close()
    if done:
        yield batch()


def learned_texts(formatted: str, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, a run of tokens each, unescaped."""
    edge = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
    starts = np.concatenate([[0], ends[:-1]])
    raw = formatted.encode()
    return [unescape(raw[starts[a] : ends[b - 1]].decode()) for a, b in zip(edge[::2], edge[1::2])]


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST of ``format_chats``' rows, from the renderings and masks alone.

    Conversations in several rows are brought together in order; their digests are running ones, so a task
    holds one row at a time.
    """
    columns = ["conv_id", "formatted", "ends", "loss"]
    whole = formatted.where("whole").select(*columns).mapInArrow(_fold, DIGEST)
    rest = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment").select(*columns).mapInArrow(_fold, DIGEST)
    return whole.unionByName(rest)


#: A conversation whose texts hold marks, asked for beside the table's.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def formatted_chats(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """All conversations and the probe's, read back from their formatted form."""
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(probe), vocabulary))


_SQL_MARK = r"regexp_replace(regexp_replace(coalesce({0}, ''), '#(\\*## (System|User|Assistant|Turn):)', '#\\\1', 'g'), '<(\\*/(turn|role)>)', '<\\\1', 'g')"

ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
),
sized AS (
  SELECT *, length({_SQL_MARK.format("text")}) + 8
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 9 WHEN 'assistant' THEN 14 ELSE 16 + length({_SQL_MARK.format("role")}) END AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

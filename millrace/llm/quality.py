"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes, framed by zero bytes. Filters of WIDTH bytes step over it; each chunk of
two neighbouring cells keeps the largest value of every filter, chunks overlap by one cell and
cover the whole text. A small layer reads every chunk; the largest of its outputs over all chunks,
and the filters' largest and least chunk values, are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remainder, text_of
from millrace.llm.toxicity import sample

DIM, WIDTH, STEP, FILTERS, HIDDEN = 6, 8, 2, 16, 12
#: Bytes of a cell; a chunk is two cells.
CELL = 128
#: At most so many labelled rows of either class are read for training.
SAMPLE = 1500
DECISION = 0.3


@dataclass
class Net:
    embedding: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH x DIM x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN (chunk maxima), FILTERS (most), FILTERS (least)
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each of its places: WIDTH x 256 x FILTERS."""
        return np.einsum("bd,wdf->wbf", self.embedding, self.filters)


def new_net(seed: int = 11) -> Net:
    r = np.random.default_rng(seed)
    n = lambda *shape, scale=0.3: r.normal(0, scale, shape).astype(np.float32)
    return Net(n(256, DIM), n(WIDTH, DIM, FILTERS), np.zeros(FILTERS, np.float32), n(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), n(HIDDEN + 2 * FILTERS, scale=0.1), np.zeros(1, np.float32))


def framed(text: bytes) -> np.ndarray:
    """The text's bytes between zero bytes, up to whole cells and the last filter's reach."""
    cells = -(-(len(text) + WIDTH) // CELL)
    return np.frombuffer(b"\0" * (WIDTH // 2) + text + b"\0" * (cells * CELL - len(text) - WIDTH // 2), np.uint8)


def cells_of(data: np.ndarray, tables: np.ndarray, places: bool = False, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest value of every filter in every cell of whole-cell data that goes on with ``after``; with ``places`` also where."""
    n = len(data) // STEP
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    if after is not None:
        padded[len(data) : len(data) + len(after)] = after
    conv = tables[0].take(padded[0 : len(data) : STEP], axis=0)
    for j in range(1, WIDTH):
        conv += tables[j].take(padded[j : j + len(data) : STEP], axis=0)
    conv = conv.reshape(n * STEP // CELL, CELL // STEP, FILTERS)
    return conv.max(1), conv.argmax(1) if places else None


def chunked(cells: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two neighbouring cells of a text (a lone cell is one chunk): values, starts of texts, first cells."""
    counts = np.diff(np.append(starts, len(cells)))
    n = np.maximum(counts - 1, 1)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    first = np.arange(n.sum()) + np.repeat(starts - begin, n)
    second = first + np.repeat((counts > 1).astype(np.int64), n)
    return np.maximum(cells[first], cells[second]), begin, first


def read(net: Net, chunks: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    act = np.maximum(chunks + net.bias, 0)
    hid = np.maximum(np.einsum("cf,fh->ch", act, net.hidden) + net.hidden_bias, 0)
    top = np.concatenate([np.maximum.reduceat(hid, begin), np.maximum.reduceat(act, begin), np.minimum.reduceat(act, begin)], 1)
    return act, hid, top


def scores(texts: list[bytes], net: Net, tables: np.ndarray) -> np.ndarray:
    """Probabilities of whole texts. A text is cut into stretches of cells, so memory stays bounded; neighbouring stretches share a cell."""
    tops: list[np.ndarray] = []
    pending: list[np.ndarray] = []
    size, most = 0, 1 << 20

    def flush():
        if pending:
            cells, _ = cells_of(np.concatenate(pending), tables)
            starts = np.concatenate([[0], np.cumsum([len(x) // CELL for x in pending])[:-1]]).astype(np.int64)
            chunks, begin, _ = chunked(cells, starts)
            tops.append(read(net, chunks, begin)[2])

    for text in texts:
        data = framed(text)
        if len(data) > most:
            flush()
            pending, size = [], 0
            cells = np.concatenate([cells_of(data[i : i + most], tables, after=data[i + most : i + most + WIDTH])[0] for i in range(0, len(data), most)])
            chunks, begin, _ = chunked(cells, np.array([0]))
            tops.append(read(net, chunks, begin)[2])
            continue
        pending.append(data)
        size += len(data)
        if size > most:
            flush()
            pending, size = [], 0
    flush()
    if not tops:
        return np.zeros(0)
    return 1 / (1 + np.exp(-(np.concatenate(tops) @ net.out + net.out_bias).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 10, rate: float = 0.01, batch: int = 32, seed: int = 11) -> Net:
    """Adam on the logistic loss; every maximum passes its gradient to the place it came from."""
    net, r = new_net(seed), np.random.default_rng(seed)
    framed_ = [framed(t) for t in texts]
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for b in range(0, len(order), batch):
            chosen = order[b : b + batch]
            data = np.concatenate([framed_[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum([len(framed_[i]) // CELL for i in chosen])[:-1]]).astype(np.int64)
            cells, places = cells_of(data, net.tables(), True)
            chunks, begin, head = chunked(cells, starts)
            act, hid, top = read(net, chunks, begin)
            p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias)))
            delta = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(x) for x in params]
            grads[5], grads[6] = top.T @ delta, delta.sum(keepdims=True)
            d_top = np.outer(delta, net.out)
            d_hid, d_act = np.zeros_like(hid), np.zeros_like(act)
            ends = np.append(begin[1:], len(chunks))
            for t, (s, e) in enumerate(zip(begin, ends)):
                d_hid[s + hid[s:e].argmax(0), np.arange(HIDDEN)] += d_top[t, :HIDDEN]
                d_act[s + act[s:e].argmax(0), np.arange(FILTERS)] += d_top[t, HIDDEN : HIDDEN + FILTERS]
                d_act[s + act[s:e].argmin(0), np.arange(FILTERS)] += d_top[t, HIDDEN + FILTERS :]
            d_hid *= hid > 0
            busy = np.flatnonzero(d_hid.any(1))
            grads[3], grads[4] = act[busy].T @ d_hid[busy], d_hid[busy].sum(0)
            d_act[busy] += d_hid[busy] @ net.hidden.T
            d_act *= act > 0
            grads[2] = d_act.sum(0)
            at, f = np.nonzero(d_act)
            g = d_act[at, f]
            nxt = np.minimum(head[at] + 1, len(cells) - 1)
            cell = np.where(cells[head[at], f] == chunks[at, f], head[at], nxt)
            spot = cell * CELL + places[cell, f] * STEP
            padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            for j in range(WIDTH):
                byte = padded[spot + j]
                np.add.at(grads[0], byte, g[:, None] * net.filters[j][:, f].T)
                np.add.at(grads[1][j].T, f, g[:, None] * net.embedding[byte])
            step += 1
            pace = rate * (1 - epoch / epochs * 0.8)
            for p_, g_, m, v in zip(params, grads, first, second):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out() -> Column:
    return remainder(F.col("doc_id"), 5) == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Net:
    """Train on the rows outside the held-out fifth; with labels of one class or none, every text scores alike."""
    rows = sample(docs, labels, "quality", ~held_out(), most, most)
    if len({x[2] for x in rows}) < 2:
        net = new_net()
        net.out[:] = 0
        net.out_bias[:] = 3.0 if not rows or rows[0][2] == 1 else -3.0
        return net
    return train([x[0] for x in rows], np.array([x[2] for x in rows], np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= DECISION).

    Null texts count as empty and score like a text of zero bytes; repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            found = scores(batch.column(1).to_pylist(), model, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array((found >= DECISION).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows and score every document (see ``score``)."""
    return score(docs, fit(docs, labels, most))

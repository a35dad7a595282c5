"""Convolutional text classifier over hashed word embeddings, trained and run in numpy.

A word's embedding is the sum of the hashed vectors of the word, its first four and five bytes and
its last three. Filters of several widths slide over the words of the whole text; each keeps its
largest value, and a logistic layer turns these into a score. Since a filter is linear in each of
its words, a word's share in every filter place is computed once and looked up afterwards. Texts
alone are scored; thresholds for decisions are calibrated by language on all labelled rows outside
the held-out quarter that were not trained on, counted in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, remainder, text_of

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: At most so many toxic rows, and twice as many others, are read for training.
SAMPLE = 2000
DECISION = 0.3
#: Thresholds that a language may take.
GRID = np.linspace(0.02, 0.98, 49)
_STRIP = b".,;:!?\"'()[]{}*#$%&"
#: Longest stretch of words scored at once; stretches overlap by the widest filter.
STRETCH = 200_000


def features(word: bytes) -> tuple[int, int, int, int]:
    """Hash buckets of a lower-case word and its pieces."""
    w = word.strip(_STRIP) or word
    crc = zlib.crc32
    return crc(w) % BUCKETS, crc(b"4" + w[:4]) % BUCKETS, crc(b"5" + w[:5]) % BUCKETS, crc(b"e" + w[-3:]) % BUCKETS


@dataclass
class Net:
    """The classifier's parameters; ``place`` holds (first filter column, offset) of every filter place."""

    embedding: np.ndarray
    filters: np.ndarray  # DIM x places, a place being one word of one width's FILTERS filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """What words (rows of four buckets) add to each filter at each of its places."""
        return np.einsum("wd,df->wf", self.embedding[ids].sum(1), self.filters)  # small sums: no BLAS threads

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    return Net(r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


def pool(shares: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter in each text, and where. ``shares`` has two rows of zeros after every text, so no filter reaches into the next."""
    n, values, places = len(shares), [], []
    for k, width in enumerate(WIDTHS):
        at = FILTERS * sum(WIDTHS[:k])
        conv = shares[:, at : at + FILTERS].copy()
        for j in range(1, width):
            conv[: n - j] += shares[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
        top = np.maximum.reduceat(conv, starts, axis=0)
        values.append(top)
        places.append(conv)
    return np.concatenate(values, 1), places


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class Lookup:
    """Words' shares by a bounded table of the words met."""

    def __init__(self, net: Net, most: int = 50_000):
        self.net, self.most, self.index = net, most, {}
        self.rows = np.zeros((1, net.filters.shape[1]), np.float32)  # row 0: no word

    def __call__(self, words: list[bytes]) -> np.ndarray:
        missing = list(set(words).difference(self.index))
        if len(self.index) + len(missing) > self.most:
            self.index, self.rows = {}, self.rows[:1]
            missing = list(set(words))
        if missing:
            ids = np.array([features(w) for w in missing], np.int64).reshape(-1, 4)
            self.index.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing))))
            self.rows = np.concatenate([self.rows, self.net.shares(ids)])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def scores(texts: list[bytes], lookup: Lookup) -> np.ndarray:
    """Scores of whole texts; a text without words scores by the bias alone."""
    net, pooled, pending, size = lookup.net, [], [], 0
    reach = max(WIDTHS) - 1

    def flush():
        if pending:
            lengths = np.array([len(w) for w in pending])
            ids = np.zeros(lengths.sum() + reach * len(pending), np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths + reach)[:-1]])
            flat = lookup([w for words in pending for w in words])
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(pending)) * reach, lengths)] = flat
            pooled.append(pool(lookup.rows[ids], starts)[0])

    for text in texts:
        words = tokens(text)
        if len(words) > STRETCH:
            flush()
            parts = [words[i : i + STRETCH + reach] for i in range(0, len(words), STRETCH)]
            pending, size = [], 0
            tops = []
            for part in parts:
                row = np.concatenate([lookup(part), np.zeros(reach, np.int64)])
                tops.append(pool(lookup.rows[row], np.array([0]))[0])
            pooled.append(np.max(tops, axis=0))
            continue
        pending.append(words)
        size += len(words) + reach
        if size > 30_000:
            flush()
            pending, size = [], 0
    flush()
    if not pooled:
        return np.zeros(0)
    return 1 / (1 + np.exp(-net.logits(np.concatenate(pooled)).astype(np.float64)))


def column_scores(column: pa.Array, lookup: Lookup, rows: int = 500) -> np.ndarray:
    """Scores of a column of texts, a few hundred of which are held as Python objects at once."""
    found = [scores([t or b"" for t in column.slice(i, rows).cast(pa.binary()).to_pylist()], lookup) for i in range(0, len(column), rows)]
    return np.concatenate([np.zeros(0), *found])


def train(texts: list[bytes], labels: np.ndarray, steps: int = 1000, rate: float = 0.01, batch: int = 32, seed: int = 7) -> Net:
    """Adam on the logistic loss over whole passes of about ``steps`` steps; a filter learns at the place of its largest value only.

    Embeddings start small, so a word never met in training barely moves a filter.
    """
    net, r = new_net(seed), np.random.default_rng(seed)
    reach = max(WIDTHS) - 1
    vocabulary: dict[bytes, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)], np.int64) for t in texts]
    buckets = np.array([features(w) for w in vocabulary] or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    params = [net.embedding, net.filters, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_state = [0.0, 0.0]
    step = 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for _ in range(max(1, -(-steps * batch // max(1, len(texts))))):
        order = r.permutation(len(texts))
        for b in range(0, len(order), batch):
            chosen = order[b : b + batch]
            lengths = np.array([len(coded[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths + reach)[:-1]])
            here = np.full(lengths.sum() + reach * len(chosen), -1, np.int64)
            flat = np.concatenate([coded[i] for i in chosen])
            here[np.arange(len(flat)) + np.repeat(np.arange(len(chosen)) * reach, lengths)] = flat
            words, inverse = np.unique(here, return_inverse=True)
            vectors = net.embedding[buckets[words]].sum(1) if len(buckets) else np.zeros((len(words), DIM), np.float32)
            vectors[words < 0] = 0
            pooled, convs = pool(np.einsum("wd,df->wf", vectors, net.filters)[inverse], starts)
            hidden = np.maximum(pooled + net.bias, 0)
            p = 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias)))
            delta = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            d_hidden = np.outer(delta, net.out) * (hidden > 0)
            grads = [np.zeros_like(net.embedding), np.zeros_like(net.filters), d_hidden.sum(0), hidden.T @ delta]
            ends = np.append(starts[1:], len(here))
            d_words = np.zeros_like(vectors)
            for k, width in enumerate(WIDTHS):
                at = FILTERS * sum(WIDTHS[:k])
                where = np.array([s + convs[k][s:e].argmax(0) for s, e in zip(starts, ends)])
                g = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    w = inverse[np.minimum(where + j, len(here) - 1)]
                    cols = slice(at + j * FILTERS, at + (j + 1) * FILTERS)
                    v = vectors[w]  # texts x FILTERS x DIM
                    grads[1][:, cols] += np.einsum("tfd,tf->df", v, g)
                    np.add.at(d_words, w, g[:, :, None] * net.filters[:, cols].T[None])
            d_words[words < 0] = 0
            if len(buckets):
                real = words >= 0
                np.add.at(grads[0], buckets[words[real]], d_words[real][:, None, :])
            step += 1
            for p_, g_, m, v in zip(params, grads, first, second):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            g0 = float(delta.sum())
            bias_state = [0.9 * bias_state[0] + 0.1 * g0, 0.999 * bias_state[1] + 0.001 * g0 * g0]
            net.out_bias -= rate * (bias_state[0] / (1 - 0.9**step)) / (np.sqrt(bias_state[1] / (1 - 0.999**step)) + 1e-8)
    return net


def calibrated(counts: dict[str | None, np.ndarray], totals: dict[str | None, np.ndarray], default: float = DECISION, prior: float = 20.0) -> dict[str | None, float]:
    """Per language the threshold of best F1, the one of equals that is nearest to ``default``.

    ``counts[lang][label, k]`` are rows not trained on whose score reaches k thresholds of GRID;
    ``totals[lang][label]`` are all labelled rows, so that each class weighs as much as it does in the
    labels whatever the share trained on. A language's score distribution of a class is drawn to that of
    all languages by ``prior`` rows, so small languages are calibrated too; one without rows of a class
    takes the threshold of all. Without rows of both classes nothing is calibrated.
    """
    whole = sum(counts.values(), np.zeros((2, len(GRID) + 1)))
    if not whole.sum(1).all():
        return {}
    shape = whole / whole.sum(1, keepdims=True)

    def best(mass: np.ndarray) -> float:
        reached = mass[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows at or above each threshold
        f1 = 2 * reached[1] / np.maximum(reached.sum(0) + mass[1].sum(), 1e-12)
        top = GRID[f1 >= f1.max() - 1e-9]
        return float(top[np.abs(top - default).argmin()])

    common = best(shape * sum(totals.values())[:, None])
    out = {}
    for lang, total in totals.items():
        own = counts.get(lang, np.zeros_like(whole))
        out[lang] = best(total[:, None] * (own + prior * shape) / (own.sum(1, keepdims=True) + prior)) if total.all() else common
    return out


def score_counts(docs: DataFrame, labels: DataFrame, net: Net, trained: list) -> tuple[dict[str | None, np.ndarray], dict[str | None, np.ndarray]]:
    """What ``calibrated`` reads, over every labelled row outside the held-out quarter. Only ids, languages and places on GRID are shuffled; ``trained`` is bounded by the sample."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            place = np.searchsorted(GRID, column_scores(batch.column(2), lookup), side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place.astype(np.int32))], names=["doc_id", "lang", "place"])

    usable = ~held_out() & F.col("doc_id").isNotNull()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    placed = docs.where(usable).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang string, place int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(usable & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    seen = F.broadcast(spark.createDataFrame([(int(i),) for i in set(trained)], "doc_id long").withColumn("trained", F.lit(True)))
    rows = placed.join(known, "doc_id").join(seen, "doc_id", "left").groupBy("lang", "label", "place", F.coalesce("trained", F.lit(False)).alias("trained")).count().collect()
    counts, totals = {}, {}
    for r in rows:
        totals.setdefault(r.lang, np.zeros(2))[r.label] += r["count"]
        if not r.trained:
            counts.setdefault(r.lang, np.zeros((2, len(GRID) + 1)))[r.label, r.place] += r["count"]
    return counts, totals


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, zeros: int, ones: int) -> list[tuple[bytes, str | None, int]]:
    """``drawn`` without the ids."""
    return [x[1:] for x in drawn(docs, labels, label, learn, zeros, ones)]


def drawn(docs: DataFrame, labels: DataFrame, label: str, learn: Column, zeros: int, ones: int) -> list[tuple[int, bytes, str | None, int]]:
    """Up to ``zeros`` and ``ones`` labelled rows of the classes that ``learn`` allows, in hash order: (doc_id, text, lang, label).

    The ids are bounded by the parameter before the documents are read, so they are broadcast.
    """
    order = F.xxhash64("doc_id")
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(learn & F.col("doc_id").isNotNull())
    pick = [rows.where(F.col("label") == y).orderBy(order, "doc_id").limit(most) for y, most in ((0, zeros), (1, ones))]
    ids = F.broadcast(pick[0].unionByName(pick[1]).groupBy("doc_id").agg(F.max("label").alias("label")))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", text_of().cast("binary").alias("text"), lang.alias("lang")).join(ids, "doc_id").select("doc_id", "text", "lang", "label")
    table = found.toArrow()
    return sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["lang"].to_pylist(), table["label"].to_pylist()), key=lambda x: (x[0], x[1]))


def held_out() -> Column:
    return remainder(F.col("doc_id"), 4) == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Net:
    """Train on a sample of the rows outside the held-out quarter, less a fifth of it; all others outside it calibrate thresholds."""
    found = drawn(docs, labels, "toxic", ~held_out(), 2 * most, most)
    rows = [x[1:] for x in found]
    if not rows or len({x[2] for x in rows}) < 2:  # nothing to learn from: all texts score alike
        net = new_net()
        net.out[:] = 0
        net.out_bias = -3.0 if not rows or rows[0][2] == 0 else 3.0
        return net
    texts, y = [x[0] for x in rows], np.array([x[2] for x in rows], np.float32)
    back = np.arange(len(rows)) % 5 == 4
    net = train([t for t, b in zip(texts, back) if not b], y[~back])
    net.thresholds = calibrated(*score_counts(docs, labels, net, [x[0] for x, b in zip(found, back) if not b]))
    return net



def score(docs: DataFrame, net: Net) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, threshold, flagged.

    ``predicted`` is score >= DECISION; ``flagged`` is score >= the threshold of the row's language (DECISION where none
    was calibrated), which the score itself never sees. Null texts count as empty and score like any text without words; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model)
        for batch in batches:
            found = column_scores(batch.column(2), lookup)
            limits = np.array([model.thresholds.get(x, DECISION) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(found, pa.float64()), pa.array((found >= DECISION).astype(np.int32)), pa.array(limits, pa.float64()), pa.array(found >= limits)],
                names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_of().cast("binary").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows and score every document (see ``score``)."""
    return score(docs, fit(docs, labels, most))


def keep_clean(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs``, all columns and types as they are, whose score lies below their language's threshold."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model)
        for batch in batches:
            found = column_scores(batch.column(at), lookup)
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(batch)
            limits = np.array([model.thresholds.get(x, DECISION) for x in langs])
            yield batch.filter(pa.array(found < limits, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

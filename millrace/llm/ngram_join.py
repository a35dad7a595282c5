"""Exact n-gram Jaccard join of whole documents, and its connected components.

Documents with equal shingle sets form one class, and one document stands for it. Sizes lie in bands;
a pair is sought in the band of its smaller set, so a set is keyed in its own band and, if a linked
set could be that small, in the band below. In a band, linked sets differ in at most d shingles, so if
the hash space is cut into more than d segments, some segments hold the same shingles in both: these
(band, segment, contents) keys are the tiles. Members of a tile are compared by hashed bitmaps of the
band's width: a bit set in one bitmap alone proves a shingle in one set alone, so bit counts bound the
overlap from above. What passes is intersected exactly as sorted arrays.

Only (key, document) rows are shuffled to find the tiles, sorted and compared with their neighbours, so
no tile is held in memory. A tile may hold a third of all documents: in each of a few rounds every
document meets one member of another component, and tiles whose members are all connected drop out. In
the rest every document outside a tile's largest component meets all members of other components: small
tiles list these pairs by id, large ones compare wider bitmaps in blocks of bounded size and list what
passes. No link between components is lost; links inside a component need not be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, bound_batches, discard, materialize, slices, text_of
from millrace.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Ratio of a band's ends, share of a document's weakest segments that its keys leave out.
RATIO, WEAKEST = 1.25, 0.08
#: Bits of a bitmap by shingle: in the screen of single pairs, and in the blocks of large tiles.
BITS, WIDE = 4, 16
#: Rounds in which a document meets one member of another component; members up to which a tile is small; members of a large tile's block.
ROUNDS, SMALL, BLOCK = 3, 32, 512
#: Pairs up to which their ids are broadcast, so that only their sets are shuffled.
FEW_PAIRS = 200_000
#: From here on nodes stand for classes whose only doc_id is null.
NAMELESS = 1 << 62
_U = np.uint64
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mix."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` consecutive words."""
    with np.errstate(over="ignore"):
        rows = len(hashes) - width + 1
        total = np.full(max(0, rows), width, _U)
        for j in range(width if rows > 0 else 0):
            total = mix(total * _U(_ODD[(j + 1) % 8]) + hashes[j : j + rows] * _U(_ODD[j % 8]))
    return total


def sets_in(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word n-grams; the whole sequence as one where words are fewer."""
    for first, last in slices(texts):
        words = [t.lower().split() for t in texts[first:last]]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), _U)
        grams, at = _rolled(hashes, n), 0
        for own in map(len, words):
            if own >= n:
                yield np.unique(grams[at : at + own - n + 1])
            else:
                yield _rolled(hashes[at : at + own], own) if own else np.zeros(0, _U)
            at += own


class Bands:
    """Size bands and what follows from them for a least similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * RATIO)))
        self.starts_array = np.array(self.starts)

    def of(self, size: int) -> list[int]:
        """The bands a size is keyed in: its own, and the one below if a set there could link to it."""
        own = int(np.searchsorted(self.starts_array, size, "right")) - 1
        return [own, own - 1] if own and self.percent * size <= 100 * (self.starts[own] - 1) else [own]

    @lru_cache(maxsize=None)  # noqa: B019
    def cut(self, band: int) -> tuple[int, int, np.ndarray]:
        """Segments that differ at most, those left out, the segments' lower ends.

        The smaller set of a pair lies in the band, so it has at most ``most`` shingles and the other 100 / percent times as many.
        """
        most = self.starts[band + 1] - 1
        d = (most + 100 * most // self.percent) * (100 - self.percent) // (100 + self.percent)
        out = -(-int((d + 1) * WEAKEST * 100) // 100) if d else 0
        k = d + 1 + 2 * out
        ends = np.array([(i << 64) // k for i in range(k)], _U)
        return d, out, ends

    def width(self, band: int, bits: int) -> int:
        """Bits of a bitmap in the band."""
        return 64 * -(-bits * self.starts[band + 1] // 64)


def tile_keys(marks: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles of a sorted set. Two linked sets share 2 x left-out + 1 segments, so one at least that neither leaves out."""
    keys = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(marks), dtype=_U)])
        for band in bands.of(len(marks)):
            d, out, ends = bands.cut(band)
            if not d:  # only equal sets link
                continue
            at = np.append(np.searchsorted(marks, ends), len(marks))
            counts = np.diff(at)
            held = np.sort(np.argsort(counts, kind="stable")[out:]) if out else np.arange(len(counts))
            content = (sums[at[1:]] - sums[at[:-1]])[held]
            keys.append(mix(content + mix(counts[held].astype(_U) + (held.astype(_U) << _U(24)) + (_U(band) << _U(56)))))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def bitmap(marks: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[((marks >> _U(7)) % _U(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """A row of two 64-bit halves for each set."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def digested(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, lo and hi (a 128-bit digest of the set, null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_in(batch.column(1).to_pylist(), n))
            halves, sizes = _digests(sets), np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *(pa.array(halves[:, i], mask=sizes == 0) for i in (0, 1))], names=["doc_id", "n_shingles", "lo", "hi"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long")


def _nameless(lo: int) -> int:
    return NAMELESS | (lo >> 2) & (NAMELESS - 1)


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) for the tiles of every document; of equal sets in one task only the least doc_ids so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, least = Bands(percent), {}
        for batch in batches:
            sets = list(sets_in(batch.column(1).to_pylist(), n))
            at: dict[bytes, int] = {}
            for i, (doc_id, s, half) in enumerate(zip(batch.column(0).to_pylist(), sets, _digests(sets))):
                digest, node = half.tobytes(), _nameless(int(half[0])) if doc_id is None else doc_id
                if len(s) and node < least.get(digest, 1 << 63):
                    least[digest], at[digest] = node, i
            keys = [tile_keys(sets[i], bands) for i in at.values()]
            nodes = np.repeat(np.array([least[d] for d in at], np.int64), [len(k) for k in keys])
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes)], names=["key", "node"])

    return texts(docs).mapInArrow(run, "key long, node long")


def mapped(nodes: list[int], sets: list[np.ndarray], bands: Bands, bits: int) -> pa.RecordBatch:
    """node, size, band, bits in its own band and the one below (empty if not keyed there), bit counts."""
    of = [bands.of(len(s)) for s in sets]
    own = [bitmap(s, bands.width(b[0], bits)) for s, b in zip(sets, of)]
    below = [bitmap(s, bands.width(b[1], bits)) if len(b) > 1 else np.zeros(0, np.int64) for s, b in zip(sets, of)]
    ones = lambda maps: pa.array([int(np.bitwise_count(m.view(_U)).sum()) for m in maps], pa.int32())
    columns = [pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([b[0] for b in of], pa.int32()), _lists(own), _lists(below), ones(own), ones(below)]
    return pa.RecordBatch.from_arrays(columns, names=["node", "size", "band", "own", "below", "own_ones", "below_ones"])


MAPPED = "node long, size long, band int, own array<long>, below array<long>, own_ones int, below_ones int"


def sets_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The bitmaps and marks (the sorted set) of the (node, text) rows that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            rows = [(node, s) for node, s in zip(batch.column(0).to_pylist(), sets_in(batch.column(1).to_pylist(), n)) if len(s)]
            sets = [s for _, s in rows]
            nodes = [_nameless(int(half[0])) if node is None else node for (node, _), half in zip(rows, _digests(sets))]
            yield mapped(nodes, sets, bands, BITS).append_column("marks", pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.select("node", "text").mapInArrow(run, f"{MAPPED}, marks binary")


def widened(sets: DataFrame, percent: int) -> DataFrame:
    """The wide bitmaps of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            yield mapped(batch.column(0).to_pylist(), [np.frombuffer(m, _U) for m in batch.column(1).to_pylist()], bands, WIDE)

    return sets.select("node", "marks").mapInArrow(run, MAPPED)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps leave room for a similarity of percent / 100."""
    c = lambda side, name: F.col(f"{side}.{name}")
    enough = lambda overlap: (100 + percent) * overlap >= percent * (c(a, "size") + c(b, "size"))

    def bound(x: str, y: str) -> Column:
        both = F.aggregate(F.zip_with(c(a, x), c(b, y), lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, v: s + v)
        return enough(both + F.least(c(a, "size") - c(a, f"{x}_ones"), c(b, "size") - c(b, f"{y}_ones")))

    step = c(a, "band") - c(b, "band")
    fits = F.when(step == 0, bound("own", "own")).when((step == 1) & (c(a, "below_ones") > 0), bound("below", "own")).when((step == -1) & (c(b, "below_ones") > 0), bound("own", "below")).otherwise(False)
    return enough(F.least(c(a, "size"), c(b, "size"))) & fits


def sets_for(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets to shuffle for the written table ``pairs``: those of its ids where these are few enough to broadcast, else all."""
    if pairs.limit(FEW_PAIRS + 1).count() > FEW_PAIRS:
        return sets
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return sets.join(F.broadcast(ids), "node", "left_semi")


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps leave possible."""
    maps = sets_for(pairs, sets.drop("marks"))
    rows = pairs.alias("p").join(maps.alias("x"), F.col("p.a") == F.col("x.node")).join(maps.alias("y"), F.col("p.b") == F.col("y.node"))
    return rows.where(may_link("x", "y", percent)).select("p.a", "p.b")


def intersect(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by exact intersection of sorted arrays."""
    marks = sets_for(pairs, sets.select("node", "marks"))
    rows = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("ma")), "a").join(marks.select(F.col("node").alias("b"), F.col("marks").alias("mb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append((100 + percent) * both >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return rows.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def tiles(rows: DataFrame) -> DataFrame:
    """The (key, node) rows whose key another row has. Neighbours in sort order decide, so a tile of any size is only streamed."""
    beside = Window.partitionBy("key").orderBy("node")
    found = rows.withColumn("before", F.lag("node").over(beside)).withColumn("after", F.lead("node").over(beside))
    return found.where("before is not null or after is not null").select("key", "node")


def mixed(rows: DataFrame) -> DataFrame:
    """The (key, node, component) rows of tiles with several components."""
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return rows.join(several, "key", "left_semi")


def meetings(rows: DataFrame, turn: int) -> DataFrame:
    """For every node one member of another component in one of its tiles, as distinct pairs a < b.

    The members on offer are each tile's least by a hash of the round (its least node in the first round),
    and the greatest by it where the least is of the node's own component.
    """
    rank = F.struct(F.lit(0).alias("h") if turn == 0 else F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")
    offers = rows.groupBy("key").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    other = F.when(F.col("first.component") != F.col("component"), F.col("first")).when(F.col("last.component") != F.col("component"), F.col("last"))
    met = rows.join(offers, "key").withColumn("met", other).where("met is not null").groupBy("node").agg(F.min("met")["node"].alias("met"))
    return met.select(F.least("node", "met").alias("a"), F.greatest("node", "met").alias("b")).distinct()


def remaining(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b with every linked pair of different components in one tile.

    Every node outside the tile's largest component meets the members of other components. Small tiles list
    all such pairs; large ones are cut into blocks, and a block lists the pairs that its bitmaps leave possible.
    """
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("others"))
    held = materialize(rows.join(largest, "key").withColumn("other", F.col("component") != F.col("main")).drop("main"), "held")
    few = held.where(F.col("members") <= SMALL)
    left, right = few.alias("l"), few.where("other").alias("r")
    once = ~F.col("l.other") | (F.col("l.node") < F.col("r.node"))
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & once & (F.col("l.component") != F.col("r.component")))
    listed = pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    out = materialize(listed.unionByName(from_blocks(held.where(F.col("members") > SMALL), sets, percent)).distinct(), "pairs")
    discard(held)
    return out


def from_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of large tiles that wide bitmaps leave possible; a block pair holds about ``BLOCK`` members of either side."""
    wide = widened(sets.join(rows.select("node").distinct(), "node", "left_semi"), percent)
    held = rows.join(wide, "node")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    slot = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), parts(c).cast("long")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    left = held.withColumn("right", F.lit(False)).withColumn("x", slot("members")).withColumn("y", every("others"))
    right = held.where("other").withColumn("right", F.lit(True)).withColumn("y", slot("others")).withColumn("x", every("members"))

    def run(group: pa.Table) -> pa.Table:
        a, b = block_pairs(group, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right.select(*left.columns)).groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as views of its values."""
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def block_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs (a < b) of one block pair: rows with ``right`` against those without, of other components."""
    get = lambda c: group.column(c).to_numpy()
    node, size, band, component, right, other = (get(c) for c in ("node", "size", "band", "component", "right", "other"))
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    maps, ones = {n: _rows(group.column(n).combine_chunks()) for n in ("own", "below")}, {n: get(f"{n}_ones") for n in ("own", "below")}
    for low in np.unique(band):
        # rows of this band by their own bitmaps, rows of the next by those of the band below
        use = [(i, "own") for i in np.flatnonzero(band == low)] + [(i, "below") for i in np.flatnonzero((band == low + 1) & (ones["below"] > 0))]
        at = np.array([i for i, _ in use])
        bits, lost = np.array([maps[n][i] for i, n in use], np.int64), size[at] - np.array([ones[n][i] for i, n in use])
        across = band[at] != low
        lefts = np.flatnonzero(~right[at])
        for r in np.flatnonzero(right[at]):
            l = lefts[(component[at[lefts]] != component[at[r]]) & (~other[at[lefts]] | (node[at[lefts]] < node[at[r]])) & ~(across[lefts] & across[r])]
            if len(l):
                both = np.bitwise_count((bits[l] & bits[r]).view(_U)).sum(1) + np.minimum(lost[l], lost[r])
                l = l[(100 + percent) * both.astype(np.int64) >= percent * (size[at[l]] + size[at[r]])]
                found.append(np.sort(np.stack([node[at[l]], np.full(len(l), node[at[r]])], 1), axis=1))
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def linked_components(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component (its least node) for the nodes of the tiles ``rows`` (key, node) that link to others."""
    labels = materialize(rows.select("node", F.col("node").alias("component")).limit(0), "labels")
    held: list[DataFrame] = []
    for turn in range(ROUNDS + 1):
        named = rows.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        rows = materialize(mixed(named), "mixed")
        pairs = materialize(meetings(rows, turn), "pairs") if turn < ROUNDS else remaining(rows, sets, percent)
        possible = materialize(screened(pairs, sets, percent), "possible")
        links = materialize(intersect(possible, sets, percent), "links")
        discard(pairs, possible)
        held += [rows, links, labels]
        if rows.isEmpty():
            break
        rows = rows.select("key", "node")
        ends = links
        for end in ("a", "b"):  # links between components: what earlier rounds joined is one node
            ends = ends.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        step = components(ends)
        moved = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(moved.unionByName(step.join(labels, "node", "left_anti")), "labels")
        held.append(step)
    discard(*(t for t in held if t is not labels))
    return labels


def join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of non-blank characters with A-Z lower-cased; a document's set holds its distinct word n-grams, or its
    whole sequence where it has fewer words. Two documents link when 100 |A and B| >= percent |A or B|; component_id is
    the smallest doc_id reachable. Null, empty and blank texts have no shingles and link with nothing. Texts of any length
    are read whole. Rows that repeat a doc_id are classed by their own texts each; texts whose smallest doc_id agrees count
    as one. A null doc_id links as any other and names no component that has another id; a component without one is named
    null. An empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    base = materialize(digested(docs, n), "digests")
    nameless = F.lit(NAMELESS).bitwiseOR(F.shiftright("lo", 2).bitwiseAND(F.lit(NAMELESS - 1)))
    classes = base.where("n_shingles > 0").groupBy("lo", "hi").agg(F.coalesce(F.min("doc_id"), nameless).alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = materialize(attach(base, classes, ["lo", "hi"], "copies").select("doc_id", "n_shingles", "rep", F.coalesce("doc_id", nameless).alias("node")), "classes")
    reps = named.where("node = rep").select("node").distinct()
    rows = materialize(tiles(keyed(docs, n, percent)).join(reps, "node", "left_semi"), "tiles")
    wanted = mixed(rows.withColumn("component", F.col("node"))).select("node").distinct()
    bodies = texts(docs).withColumnRenamed("doc_id", "node")
    unnamed = sets_of(bodies.where("node is null"), n, percent).dropDuplicates(["node"]).join(wanted, "node", "left_semi")
    sets = materialize(sets_of(bodies.join(wanted, "node", "left_semi"), n, percent).unionByName(unnamed), "sets")
    labels = linked_components(rows, sets, percent)
    discard(base, rows, sets)
    copies = named.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    found = attach(named, materialize(copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left"), "named"), ["rep"], "copies")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", "n_shingles", F.when(component < NAMELESS, component).alias("component_id"))


def representatives(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their component: those of its smallest doc_id."""
    stay = join(docs, n, percent).where("doc_id <=> component_id").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct([list_aggregate(w[i:i + 3], 'string_agg', ' ') FOR i IN range(1, len(w) - 2)]) END AS g
  FROM words),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM grams),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM grams
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM grams g JOIN reach r ON r.a = g.doc_id GROUP BY g.doc_id, len(g.g)
"""

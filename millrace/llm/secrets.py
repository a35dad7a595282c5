"""Secret scans that weigh each candidate by how widely the corpus owns it.

One pass finds candidates. Their hashes are counted over distinct repositories and owners: first
per hash and owner, then per hash, so that a value copied into a third of all documents is summed
where it was read; its verdict comes back by a broadcast of the few values that can be so frequent. A value that several owners hold is a copied example; one that a single owner
(or few) hold looks live. Provider patterns beyond the base kinds are reported where they look live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, materialize, text_of

#: Base kinds: pattern, the group whose length counts, its least length. Fixed values.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Kinds that the method adds: publicly documented token formats. Fixed values.
ADDED = (
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("prefixed", re.compile(r"(?:gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END (?:[A-Z]+ )?PRIVATE KEY-----")),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, _ in ADDED)
#: Distinct owners from which a value counts as a copied example.
EXAMPLE_OWNERS = 3


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, value) of all candidates, base kinds and added ones, sorted."""
    found = []
    for order, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), order, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    for order, (_, pattern) in enumerate(ADDED, len(BASE)):
        found += [(m.start(), order, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


FOUND = "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base string, base_sha256 string, found array<struct<start:int,kind:int,end:int,value:string,first:boolean>>"


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """A row per document with its candidates; ``first`` marks a value's first place in the document."""
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("base_sha256", pa.string())]
        + [("found", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("first", pa.bool_())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(3).to_pylist():
                found = scan(text)
                base = [x[:3] for x in found if x[1] < len(BASE)]
                listed = written(base)
                seen: set[str] = set()
                cells = []
                for start, kind, end, value in found:
                    digest = hashlib.sha256(value.encode()).hexdigest()
                    cells.append({"start": start, "kind": kind, "end": end, "value": digest, "first": digest not in seen})
                    seen.add(digest)
                for column, value in zip(columns, (row, *(sum(x[1] == k for x in base) for k in range(3)), listed, hashlib.sha256(listed.encode()).hexdigest(), cells)):
                    column.append(value)
                row += 1
            arrays = [columns[0], batch.column(0), batch.column(1), batch.column(2), *columns[1:]]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text_of().alias("text"))
    return rows.mapInArrow(run, FOUND)


def ownership(spans: DataFrame) -> DataFrame:
    """Per value: distinct repositories and owners; a null counts as one of either."""
    unnamed = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    held = spans.where("first").select("value", unnamed("owner").alias("owner"), unnamed("repository").alias("repository"))
    distinct = lambda c: held.groupBy("value", c).agg(F.lit(1).alias("one")).groupBy("value").agg(F.sum("one").alias(f"{c}s"))
    return distinct("owner").join(distinct("repository").withColumnRenamed("repositorys", "repositories"), "value")


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``spans`` lists the base spans, and added spans whose value looks live; ``n_live`` and ``n_example``
    count the candidates (base and added) by the verdict. Spans that start together are listed by kind. Null texts count as empty and have no spans;
    texts of any length are scanned in time linear in their length; repeated rows count as
    one repository where its name agrees; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(candidates(docs, owner, repository), "candidates")
    spans = rows.select("row", "owner", "repository", F.inline("found"))
    held = materialize(spans, "spans")
    verdicts = ownership(held).join(held.groupBy("value").agg(F.count(F.lit(1)).alias("copies")), "value")
    live = (F.col("owners") < example_owners) | (F.col("repositories") < example_owners)
    judged = attach(held.drop("owner", "repository", "first"), materialize(verdicts.select("value", "copies", live.alias("live")), "verdicts"), ["value"], "copies")
    part = F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1), "start", "end")
    told = F.col("live") | (F.col("kind") < len(BASE))
    per = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("start", "kind", part.alias("part"))))), lambda x: x["part"]), ",").alias("spans"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(per, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example")
    )

"""Sources: feeds, sitemaps, report files and observation lines, read by Spark and parsed per file."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

FEED_SCHEMA = "path string, kind string, feed_title string, title string, link string, published string, summary string"
SITEMAP_SCHEMA = "path string, url string, lastmod string, changefreq string, priority double, is_index boolean"
OBSERVATIONS = StructType(
    [StructField("case_id", StringType()), StructField("arm", StringType()), StructField("ok", BooleanType()), StructField("returned_chars", LongType()), StructField("latency_ms", DoubleType()), StructField("recovery_used", BooleanType()), StructField("error", StringType())]
)


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _child(node: ET.Element, *names: str) -> str | None:
    for child in node:
        if _plain(child.tag) in names:
            return (child.text or child.get("href") or "").strip()
    return None


def _root(text: str) -> ET.Element | None:
    """A document's root; none of malformed text, nor of one that declares a document type, which could expand without bound."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        return None
    try:
        return ET.fromstring(text.strip())
    except ET.ParseError:
        return None


def parse_feed(text: str) -> list[tuple]:
    """(kind, feed title, title, link, published, summary) of RSS 2.0, RDF and Atom entries; malformed text and text with a DTD has none."""
    root = _root(text)
    if root is None:
        return []
    kind = {"rss": "rss", "rdf": "rdf", "feed": "atom"}.get(_plain(root.tag))
    if kind is None:
        return []
    channel = root if kind == "atom" else next((c for c in root if _plain(c.tag) == "channel"), root)
    entries = [n for n in root.iter() if _plain(n.tag) == ("entry" if kind == "atom" else "item")]
    return [(kind, _child(channel, "title"), _child(e, "title"), _child(e, "link"), _child(e, "pubdate", "published", "updated", "date"), _child(e, "description", "summary", "content")) for e in entries]


def parse_sitemap(text: str) -> list[tuple]:
    """(url, lastmod, changefreq, priority, is_index) of a sitemap or an index of them; a bad priority is null; malformed text and text with a DTD has none."""
    root = _root(text)
    if root is None:
        return []

    def number(x: str | None) -> float | None:
        try:
            return float(x) if x else None
        except ValueError:
            return None

    return [(_child(n, "loc"), _child(n, "lastmod"), _child(n, "changefreq"), number(_child(n, "priority")), _plain(root.tag) == "sitemapindex") for n in root if _plain(n.tag) in ("url", "sitemap") and _child(n, "loc")]


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(p, *row) for p, content in zip(batch["path"], batch["content"]) for row in parse(bytes(content).decode("utf-8-sig", "replace"))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """A row per entry of the feed files under a path."""
    return _files(spark, path, parse_feed, FEED_SCHEMA)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """A row per location of the sitemap files under a path; locations differing by case or a last slash count once."""
    rows = _files(spark, path, parse_sitemap, SITEMAP_SCHEMA)
    return rows.groupBy(F.lower(F.rtrim("url", F.lit("/"))).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.struct("path", "url")).alias("r")).select("r.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Every live_report.json under a path with the file it came from; corrupt files are left out."""
    return spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "live_report.json").option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of paired trials; absent keys take their defaults."""
    return spark.read.schema(OBSERVATIONS).json(path).na.fill({"ok": False, "returned_chars": 0, "recovery_used": False})

"""Sinks: tables by format, rendered tables, text exposition of metrics, graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "parquet", "orc", "markdown", "html")


def as_text(df: DataFrame) -> DataFrame:
    """All columns as strings, nested ones as JSON, null as the empty string, in their declared order."""
    nested = ("array", "map", "struct")
    return df.select(*[F.coalesce(F.to_json(c) if t.startswith(nested) else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes])


def markdown_rows(df: DataFrame) -> DataFrame:
    """One ``line`` per row of a Markdown table; bars in cells are escaped."""
    cells = [F.replace(F.col(c), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return as_text(df).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(df: DataFrame) -> DataFrame:
    """One ``line`` per row of an HTML table, cells escaped."""
    return as_text(df).select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escaped(F.col(c)), F.lit("</td>")) for c in df.columns], F.lit("</tr>")).alias("line"))


def export(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Write a table; an unknown format or an empty path is refused."""
    if kind not in FORMATS or not path:
        raise ValueError(f"a path and one of {', '.join(FORMATS)} are needed")
    if kind == "markdown":
        markdown_rows(df).write.mode(mode).text(path)
    elif kind == "html":
        html_rows(df).write.mode(mode).text(path)
    elif kind == "csv":
        as_text(df).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(kind).save(path)


def exposition(metrics: DataFrame) -> DataFrame:
    """``line`` per metric (name, labels map, value) in the text exposition format."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GEXF elements of nodes (id, label) and edges (a, b, weight), labels escaped."""
    node = nodes.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" label="'), _escaped(F.col("label")), F.lit('"/>')).alias("line"))
    edge = edges.select(F.concat(F.lit('<edge source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    return node.unionByName(edge)

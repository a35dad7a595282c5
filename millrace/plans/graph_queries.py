"""Graph queries over documents, pages and near-duplicate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import web as U
from millrace.operators import graph as G
from millrace.plans.dedup_queries import near_dup_pairs
from millrace.plans.registry import ORACLE_SQL, query, table

_M = "WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}')) AS name FROM documents" for k, p in G.ENTITY_PATTERNS.items()) + ")"


@query("entities", _M + r"SELECT kind, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS key, min(name) AS name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1, 2")
def entities(spark, sf_dir):
    return G.entities(G.mentions(table(spark, sf_dir, "documents")))


_T = r"""
WITH w AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT least(a.term, b.term) AS term_a, greatest(a.term, b.term) AS term_b, count(*) AS pairs FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 10 AND a.term < b.term GROUP BY 1, 2
"""


@query("cooccurrence", _T)
def cooccurrence(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return G.cooccurrence(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(w).alias("pos", "term")), 10)


@query("entity_cooccurrence")
def entity_cooccurrence(spark, sf_dir):
    """Entities of all documents that stand at most 50 characters apart, by weight; tests compare with brute force."""
    return G.weighted(G.cooccurrence(G.positions(table(spark, sf_dir, "documents")), 50))


def _edges(spark, sf_dir):
    return near_dup_pairs(spark, sf_dir).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


_PAIRS = ORACLE_SQL["near_dup_pairs"].strip()
_HEAD, _TAIL = _PAIRS.rsplit("SELECT a.id AS doc_a", 1)
_EDGES = _HEAD.replace("WITH sources", "WITH RECURSIVE sources", 1) + ", edges AS (SELECT a.id AS a" + _TAIL.replace("b.id AS doc_b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance", "b.id AS b") + ")"


@query("components", _EDGES + """
, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT node, min(seen) AS component FROM reach GROUP BY node
""")
def components(spark, sf_dir):
    return G.components(_edges(spark, sf_dir))


@query("degrees", _EDGES + """
, ends AS (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges), d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT node, degree, round(degree / max(degree) OVER (), 3) AS share FROM d
""")
def degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


_LINKS = r"""
WITH RECURSIVE l AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a[^>]+href=["'']([^"'']*)["'']', 1)) AS dst FROM pages)
"""


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("src"), F.explode(U.links(F.col("html"))).alias("dst")).distinct()


@query("host_neighbours", _LINKS + "SELECT DISTINCT dst AS seed, src AS node FROM l WHERE dst = (SELECT min(dst) FROM l)")
def host_neighbours(spark, sf_dir):
    edges = _links(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return G.neighbours(edges, edges.agg(F.min("b").alias("node")))


@query("frontier", _LINKS + """
, two AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
start AS (SELECT min(src) AS node FROM l),
one_ AS (SELECT DISTINCT dst AS node FROM two JOIN start ON src = node),
two_ AS (SELECT DISTINCT dst AS node FROM two JOIN one_ ON src = node)
SELECT node, min(level)::INTEGER AS level FROM (SELECT node, 0 AS level FROM start UNION ALL SELECT node, 1 FROM one_ UNION ALL SELECT node, 2 FROM two_) GROUP BY node
""")
def frontier(spark, sf_dir):
    l = _links(spark, sf_dir)
    both = l.unionByName(l.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.frontier(both, l.agg(F.min("src").alias("node")), 2)

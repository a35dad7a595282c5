"""Passages and contexts: chunks of all documents, and what the benchmark's items get from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import passages as P
from millrace.operators import rag
from millrace.plans.registry import query, table
from millrace.storage import written

MOST, OVERLAP, BUDGET = 120, 25, 400


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{P.WS}+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{P.WS}+|{P.WS}+$', '', 'g')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({_strip(x)}, '([.!?。！？]){P.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _terms(x: str) -> str:
    marks = r"[.,;:!?()\[\]{}<>\"''`*_#\-$%\^&+=|~]"
    stop = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
    return f"list_filter(list_distinct(list_transform({_words(f'lower({x})')}, lambda w: regexp_replace(w, '^{marks}+|{marks}+$', '', 'g'))), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"


#: The same fold as rows: sentences into pieces, pieces into chunks, a step of either per level of a recursion.
_CHUNKS = f"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p0 AS (SELECT doc_id, t, string_split_regex(t, '\\n\\n+') AS parts, regexp_extract_all(t, '\\n\\n+') AS gaps FROM d),
p1 AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, parts, gaps FROM p0),
p AS (
  SELECT doc_id, i, part, {_strip("part")} AS bare, (sum(length(part) + length(coalesce(gaps[i], ''))) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(part) - length(coalesce(gaps[i], '')) AS pos FROM p1
),
s0 AS (SELECT doc_id, i, {_sentences("bare")} AS ss FROM p WHERE len({_words("bare")}) > {MOST}),
s AS (SELECT doc_id, i, ss, list_transform(ss, lambda x: len({_words("x")})) AS ns FROM s0 WHERE len(ss) > 1),
pk AS (
  SELECT doc_id, i, 1 AS j, ss[1] AS text, ns[1] AS n, NULL::VARCHAR AS done FROM s
  UNION ALL
  SELECT doc_id, i, j + 1, CASE WHEN n + ns[j + 1] > {MOST} THEN ss[j + 1] ELSE pk.text || ' ' || ss[j + 1] END, CASE WHEN n + ns[j + 1] > {MOST} THEN ns[j + 1] ELSE n + ns[j + 1] END, CASE WHEN n + ns[j + 1] > {MOST} THEN pk.text END
  FROM pk JOIN s USING (doc_id, i) WHERE j < len(ss)
),
cut AS (SELECT doc_id, i, j, done AS text FROM pk WHERE done IS NOT NULL UNION ALL SELECT doc_id, i, j + 1, pk.text FROM pk JOIN s USING (doc_id, i) WHERE j = len(ss)),
pieces AS (
  SELECT doc_id, i, 0 AS j, pos, bare AS text, len({_words("bare")}) <= {MOST} AS whole, true AS lead FROM p ANTI JOIN s USING (doc_id, i) WHERE bare <> ''
  UNION ALL
  SELECT doc_id, i, j, pos, cut.text, false, j = min(j) OVER (PARTITION BY doc_id, i) FROM cut JOIN p USING (doc_id, i)
),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, len({_words("text")}) AS n FROM pieces),
g AS (
  SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS at, '' AS text, 0::BIGINT AS n, 0::BIGINT AS start, NULL::STRUCT(text VARCHAR, "start" BIGINT, "end" BIGINT, words BIGINT) AS done FROM d
  UNION ALL
  SELECT doc_id, k, b0 + length(x), CASE WHEN toomuch THEN tail || ' ' || x WHEN text = '' THEN x ELSE text || ' ' || x END,
    CASE WHEN toomuch THEN len({_words("tail")}) + m ELSE n + m END, CASE WHEN toomuch OR text = '' THEN b0 ELSE start END,
    CASE WHEN toomuch THEN {{'text': text, 'start': start, 'end': b0, 'words': n}} END
  FROM (
    SELECT *, CASE WHEN toomuch THEN array_to_string(list_slice(ss, -greatest(1, len(list_filter(range(1, len(ss) + 1), lambda z: list_sum(list_transform(list_slice(ss, -z, len(ss)), lambda y: len({_words("y")}))) <= {OVERLAP}))), len(ss)), ' ') END AS tail
    FROM (
      SELECT *, text <> '' AND n + m > {MOST} AS toomuch, CASE WHEN text <> '' AND n + m > {MOST} THEN {_sentences("text")} END AS ss,
        CASE WHEN whole THEN pos WHEN contains(substr(t, after + 1), x) THEN after + strpos(substr(t, after + 1), x) - 1 ELSE after END AS b0
      FROM (SELECT g.doc_id, q.k, q.text AS x, q.n AS m, q.whole, q.pos, g.text, g.n, g.start, d.t, CASE WHEN q.lead THEN q.pos ELSE g.at END AS after FROM g JOIN q ON q.doc_id = g.doc_id AND q.k = g.k + 1 JOIN d ON d.doc_id = g.doc_id)
    )
  )
),
ends AS (
  SELECT doc_id, k, done FROM g WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, k + 1, {{'text': text, 'start': start, 'end': length(t), 'words': n}} FROM (SELECT doc_id, arg_max(g, k) AS g FROM g GROUP BY doc_id) JOIN d USING (doc_id), LATERAL (SELECT g.k, g.text, g.start, g.n) WHERE text <> ''
),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS chunk, done.text AS text, done."start" AS start, done."end" AS "end", done.words AS words FROM ends)
"""


@query("semantic_chunks", f"""
WITH RECURSIVE {_CHUNKS}
SELECT doc_id, chunk, CASE WHEN chunk > 0 THEN chunk - 1 END AS parent, start::INTEGER AS start, "end"::INTEGER AS "end", words::INTEGER AS words, round(words * 1.3::DOUBLE, 1) AS tokens, md5(text) AS text FROM chunks
""")
def semantic_chunks(spark, sf_dir):
    """Every document, in chunks of at most 120 words with an overlap of 25."""
    c = rag.prepare(table(spark, sf_dir, "documents"), MOST, OVERLAP)
    return c.select("doc_id", "chunk", "parent", "start", "end", "words", F.round("tokens", 1).alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("rag_context", f"""
WITH RECURSIVE {_CHUNKS},
ask0 AS (SELECT item_id AS query_id, {_strip("coalesce(text, '')")} AS t FROM benchmark),
ask1 AS (SELECT *, {_words("t")} AS w, list_filter({_words("t")}, lambda x: len({_words("t")}) <= 3 OR lower(x) NOT IN ({", ".join(f"'{w}'" for w in P.DROPPED)})) AS kept FROM ask0),
ask2 AS (SELECT query_id, CASE WHEN len(kept) <> len(w) THEN array_to_string(kept, ' ') ELSE t END AS r, t <> '' AND (len(kept) <> len(w) OR {" OR ".join(f"contains(lower(t), '{p}')" for p in P.PATTERNS)}) AS changed FROM ask1),
ask3 AS (SELECT *, {_terms("r")} AS ct, list_filter(list_distinct(list_transform({_words("lower(r)")}, lambda w: regexp_replace(w, '^[.,;:!?]+|[.,;:!?]+$', '', 'g'))), lambda w: w <> '') AS raw FROM ask2),
ask AS (SELECT query_id, CASE WHEN changed THEN r END AS rewritten_query, CASE WHEN len(ct) > 0 THEN ct ELSE raw END AS terms FROM ask3),
sets AS (SELECT *, {_terms("text")} AS ts FROM chunks),
post AS (SELECT doc_id, chunk, unnest(ts) AS term FROM sets),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
wt AS (SELECT query_id, term, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1 AS w FROM (SELECT query_id, unnest(terms) AS term FROM ask) LEFT JOIN df USING (term), (SELECT count(*) AS n FROM chunks)),
tot AS (SELECT query_id, sum(w) AS total FROM wt GROUP BY query_id),
sc AS (SELECT query_id, doc_id, chunk, round(sum(w / total), 4) AS score FROM wt JOIN tot USING (query_id) JOIN post USING (term) GROUP BY ALL),
pad AS (SELECT query_id, doc_id, chunk, 0.0::DOUBLE AS score FROM ask, (SELECT doc_id, chunk FROM chunks ORDER BY ALL LIMIT 10) WHERE (query_id, doc_id, chunk) NOT IN (SELECT (query_id, doc_id, chunk) FROM sc)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk) AS rank FROM (FROM sc UNION ALL FROM pad) QUALIFY rank <= 5),
b AS (SELECT query_id, rank, doc_id, chunk, text, words, ts, terms FROM best JOIN sets USING (doc_id, chunk) JOIN ask USING (query_id)),
w2 AS (SELECT query_id, term, ln((count(DISTINCT rank) + 1.0::DOUBLE) / (count(*) FILTER (list_contains(ts, term)) + 1.0::DOUBLE)) + 1 AS w FROM (SELECT query_id, rank, ts, unnest(terms) AS term FROM b) GROUP BY ALL),
v AS (SELECT query_id, rank, round(coalesce(sum(w) FILTER (list_contains(ts, term)) / sum(w), 0), 4) AS v FROM b LEFT JOIN w2 USING (query_id) GROUP BY ALL),
o AS (SELECT *, sum(words * 1.3::DOUBLE) OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS place FROM b JOIN v USING (query_id, rank)),
u AS (SELECT * FROM o WHERE tokens <= {BUDGET}),
ks0 AS (SELECT query_id, place, terms, {_sentences("text")} AS ss FROM u),
ks1 AS (SELECT query_id, place, terms, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM ks0),
ks2 AS (SELECT *, {_terms("s")} AS st, count(*) OVER (PARTITION BY query_id, place) AS n FROM ks1),
kw AS (SELECT query_id, place, term, ln((any_value(n) + 1.0::DOUBLE) / (count(*) FILTER (list_contains(st, term)) + 1.0::DOUBLE)) + 1 AS w FROM (SELECT query_id, place, n, st, unnest(terms) AS term FROM ks2) GROUP BY ALL),
kv AS (SELECT query_id, place, i, s, round(coalesce(sum(w) FILTER (list_contains(st, term)) / sum(w), 0), 10) AS v FROM ks2 LEFT JOIN kw USING (query_id, place) GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY v DESC, i) AS r, max(v) OVER (PARTITION BY query_id, place) AS most FROM kv),
ksel AS (SELECT query_id, place, r, s, array_to_string({_words("lower(s)")}, ' ') AS key FROM kr WHERE r <= 3 AND (v > 0 OR most = 0)),
kd AS (SELECT * FROM ksel WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY place, r) = 1),
parts AS (SELECT query_id, place, string_agg(s, ' ' ORDER BY r) AS part FROM kd GROUP BY ALL),
ctx AS (SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY place) AS context FROM parts GROUP BY query_id),
us AS (SELECT query_id, string_agg(doc_id || ':' || chunk, ',' ORDER BY place) AS used FROM u GROUP BY query_id),
sco AS (SELECT query_id, round(avg(v), 4) AS retrieval_score, round(least(1.0, 2 * avg(v)), 4) AS confidence FROM v GROUP BY query_id)
SELECT query_id, rewritten_query, coalesce(used, '') AS used, coalesce(context, '') AS context, retrieval_score, confidence FROM sco JOIN ask USING (query_id) LEFT JOIN us USING (query_id) LEFT JOIN ctx USING (query_id)
""")
def rag_context(spark, sf_dir):
    """Every word of every benchmark item asks; contexts of 400 tokens from the chunks of all documents."""
    chunks = written(rag.prepare(table(spark, sf_dir, "documents"), MOST, OVERLAP), "chunks")
    return rag.rag_context(chunks, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5, BUDGET)

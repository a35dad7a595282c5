"""Passage retrieval: chunks of documents, the best of them per query, and a compressed context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import passages as P
from millrace.operators.retrieval import best_matches, blocks_of, only_asked, top, vocabulary
from millrace.storage import written

BUDGET = 2000


def prepare(docs: DataFrame, most: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk (0, 1, ..), parent (the chunk before, null for the first), text, start, end, words, tokens of all documents."""
    cut = docs.select("doc_id", F.posexplode(P.semantic_chunks(F.coalesce(F.col("text"), F.lit("")), most, overlap)).alias("chunk", "c"))
    return cut.select("doc_id", "chunk", F.when(F.col("chunk") > 0, F.col("chunk") - 1).alias("parent"), "c.text", "c.start", "c.end", "c.words", (F.col("c.words") * P.TOKENS_A_WORD).alias("tokens"))


def best_chunks(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, chunk, score, rank: the k chunks that hold the largest weighted share of a query's terms.

    A term weighs ln((n + 1) / (df + 1)) + 1 over all chunks. Equal scores go by document and chunk; a query that
    fewer than k chunks match is filled up with the first chunks of all, at a score of 0.
    """
    item = ["doc_id", "chunk"]
    terms = written(asked.select("query_id", F.explode("terms").alias("term")), "asked")
    total = chunks.agg(F.count(F.lit(1)).alias("n"))
    found = asked.select("query_id").join(chunks.select(*item).limit(0)).select("query_id", *item, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    for some in blocks_of(terms):
        held = written(only_asked(chunks.select(*item, P.content_terms(F.col("text")).alias("terms")), vocabulary(some)), "held")
        df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = some.join(df, "term", "left").join(F.broadcast(total)).select("query_id", "term", (F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("w"))
        weighed = written(weighed, "weighed")
        sums = weighed.groupBy("query_id").agg(F.sum("w").alias("sum"))
        shares = weighed.join(sums, "query_id").select("query_id", "term", (F.col("w") / F.col("sum")).alias("weight"))
        found = found.unionByName(best_matches(shares, held, k, item, digits=4))
    found = written(found, "found")
    # k matches at most stand among the first 2 k chunks, so k of these are left to fill up with
    first = chunks.select(F.struct(*item).alias("item")).orderBy("item").limit(2 * k).agg(F.collect_list("item").alias("items"))
    lacking = asked.select("query_id").join(found.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    fill = lacking.join(F.broadcast(first)).select("query_id", F.inline("items")).join(found.select("query_id", *item), ["query_id", *item], "left_anti")
    return top(found.drop("rank").unionByName(fill.withColumn("score", F.lit(0.0))), "query_id", "score", item, k)


def compressed(items: Column, terms: Column, budget: float) -> Column:
    """The context of some chunks (struct of rank, text, words, ..) in order of rank.

    Chunks are scored again among themselves; in that order they are used until one exceeds the budget of tokens;
    of each, the key sentences that no earlier chunk gave (but for case and blanks) stay.
    struct(used, context, retrieval_score, confidence).
    """
    shares = P.idf_share(F.transform(items, lambda x: P.content_terms(x["text"])), terms)
    order = F.array_sort(F.transform(F.arrays_zip(items.alias("x"), shares.alias("v")), lambda z: F.struct((-F.round(z["v"], 4)).alias("v"), z["x"]["rank"].alias("rank"), z["x"].alias("x"))))

    def keep(ordered: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(ordered)), lambda n: F.aggregate(F.slice(ordered, 1, n), F.lit(0.0), lambda a, z: a + z["x"]["words"] * P.TOKENS_A_WORD))
        used = F.slice(ordered, 1, F.size(F.filter(sums, lambda s: s <= budget)))
        none = F.array().cast("array<string>")
        start = F.struct(none.alias("seen"), none.alias("parts"))

        def add(s: Column, z: Column) -> Column:
            def fresh(listed: Column) -> Column:
                def told(keys: Column) -> Column:
                    new = F.filter(listed, lambda t, i: P.let(F.element_at(keys, i + 1), lambda key: (key != "") & ~F.array_contains(s["seen"], key) & (F.array_position(keys, key) == i + 1)))
                    return P.let(new, lambda n: F.struct(F.concat(s["seen"], keys).alias("seen"), F.when(F.size(n) > 0, F.concat(s["parts"], F.array(F.array_join(n, " ")))).otherwise(s["parts"]).alias("parts")))

                return P.let(F.transform(listed, lambda t: F.array_join(P.words(F.lower(t)), " ")), told)

            return P.let(P.key_sentences(z["x"]["text"], terms), fresh)

        score = F.aggregate(ordered, F.lit(0.0), lambda a, z: a - z["v"]) / F.size(ordered)
        context = F.array_join(F.aggregate(used, start, add, lambda s: s["parts"]), "\n\n")
        return F.struct(F.transform(used, lambda z: z["x"]).alias("used"), context.alias("context"), score.alias("retrieval_score"), F.least(F.lit(1.0), 2 * score).alias("confidence"))

    return P.let(order, keep)


def rag_context(chunks: DataFrame, queries: DataFrame, k: int = 5, budget: float = BUDGET) -> DataFrame:
    """Per query (query_id, query): rewritten_query (null if unchanged), used (doc_id:chunk, in order), context, retrieval_score, confidence.

    ``chunks`` is what ``prepare`` gives and should be a written table. A query without terms gets the first chunks
    at a score of 0; without chunks there are no rows.
    """
    asked = queries.select("query_id", P.rewritten_query(F.col("query")).alias("r"))
    asked = asked.select("query_id", F.when(F.col("r.changed"), F.col("r.query")).alias("rewritten_query"), P.query_terms(F.col("r.query")).alias("terms"))
    found = best_chunks(chunks, asked, k).select("query_id", "rank", "doc_id", "chunk")
    rows = found.join(chunks.select("doc_id", "chunk", "text", "words"), ["doc_id", "chunk"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk", "text", "words"))).alias("items"))
    out = rows.join(asked, "query_id").select("query_id", "rewritten_query", compressed(F.col("items"), F.col("terms"), budget).alias("c"))
    used = F.array_join(F.transform("c.used", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["chunk"].cast("string"))), ",")
    return out.select("query_id", "rewritten_query", used.alias("used"), "c.context", F.round("c.retrieval_score", 4).alias("retrieval_score"), F.round("c.confidence", 4).alias("confidence"))

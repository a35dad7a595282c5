"""Passages: content terms, sentences, chunks at sentence borders, and the scores that rank them. Columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same for Java's expressions, where one test of a character takes the place of twelve.
BLANK = r"(?U)[\s\x1c-\x1f]+"
SENTENCE_END = r"(?U)(?<=[.!?。！？])[\s\x1c-\x1f]+"

# Words that tell passages apart badly, the marks that are trimmed from tokens, and the words that a rewritten query drops.
STOP_WORDS = """
a an and are as at be been but by can could did do does for from had has have how if in into is it its may me might must my of on or our
shall should so than that the their them then there these they this those to was we were what when where which while who why will with would you your
long much many take takes get got make makes way ways use used using one two
""".split()
TRIMMED = ".,;:!?()[]{}<>\"'`*_#-$%^&+=|~"
TRIMMED_QUERY = ".,;:!?"
DROPPED = "the a an is are was were be been".split()
PATTERNS = ("how to", "what is", "why", "best", "vs")

TOKENS_A_WORD = 1.3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _trimmed(tokens: Column, marks: str) -> Column:
    return F.transform(tokens, lambda w: F.btrim(w, F.lit(marks)))


def content_terms(text: Column) -> Column:
    """Distinct lower-case tokens without marks around them, of two characters or more, without stop words; null text has none."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    tokens = _trimmed(words(F.lower(F.coalesce(text, F.lit("")))), TRIMMED)
    return F.array_except(F.array_distinct(F.filter(tokens, lambda w: F.length(w) >= 2)), stop)


def query_terms(query: Column) -> Column:
    """Content terms, or all tokens if the query has stop words only."""
    raw = F.array_distinct(F.filter(_trimmed(words(F.lower(F.coalesce(query, F.lit("")))), TRIMMED_QUERY), lambda w: w != ""))
    return let(content_terms(query), lambda t: F.when(F.size(t) > 0, t).otherwise(raw))


def rewritten_query(query: Column) -> Column:
    """struct(query, changed): stop words dropped from queries of over three words; a known question pattern counts as a change."""
    text = strip(F.coalesce(query, F.lit("")))
    found = F.lit(False)
    for p in PATTERNS:
        found = found | F.contains(F.lower(text), F.lit(p))

    def of(w: Column) -> Column:
        kept = F.filter(w, lambda x: ~F.lower(x).isin(*DROPPED) | (F.size(w) <= 3))
        less = F.size(kept) != F.size(w)
        return F.struct(F.when(less, F.array_join(kept, " ")).otherwise(text).alias("query"), ((text != "") & (found | less)).alias("changed"))

    return let(words(text), of)


def idf_share(sets: Column, terms: Column) -> Column:
    """For each of some sets of terms, the share of the query's terms it has, weighted by ln((n + 1) / (df + 1)) + 1 over these sets."""
    def over(sets: Column) -> Column:
        n = F.size(sets)
        weigh = F.transform(terms, lambda t: F.struct(t.alias("t"), (F.log((n + 1.0) / (F.size(F.filter(sets, lambda s: F.array_contains(s, t))) + 1.0)) + 1.0).alias("w")))

        def shares(pairs: Column) -> Column:
            total = F.aggregate(pairs, F.lit(0.0), lambda at, p: at + p["w"])
            part = lambda s: F.aggregate(pairs, F.lit(0.0), lambda at, p: at + F.when(F.array_contains(s, p["t"]), p["w"]).otherwise(0.0))
            return let(total, lambda whole: F.transform(sets, lambda s: F.when(whole == 0, 0.0).otherwise(part(s) / whole)))

        return let(weigh, shares)

    return let(sets, over)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def key_sentences(text: Column, terms: Column, most: int = 3) -> Column:
    """The best sentences by ``idf_share`` over the text's own sentences; those that share nothing are left out, unless all are: then the first ones."""

    def best(listed: Column) -> Column:
        scored = F.transform(F.arrays_zip(listed.alias("s"), idf_share(F.transform(listed, content_terms), terms).alias("v")), lambda x, i: F.struct((-F.round(x["v"], 10)).alias("v"), i.alias("i"), x["s"].alias("s")))
        top = F.filter(F.slice(F.array_sort(scored), 1, most), lambda x: x["v"] < 0)
        first = F.slice(listed, 1, most)
        return F.when(F.size(listed) == 0, F.array(text)).otherwise(let(top, lambda t: F.when(F.size(t) > 0, F.transform(t, lambda x: x["s"])).otherwise(first)))

    return let(sentences(text), best)


def _packed(listed: Column, most: int) -> Column:
    """Sentences joined in order while a piece stays within ``most`` words."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("words"), F.array().cast("array<string>").alias("done"))

    def add(s: Column, x: Column) -> Column:
        full = (s["text"] != "") & (s["words"] + x["n"] > most)
        return F.when(full, F.struct(x["s"].alias("text"), x["n"].alias("words"), F.concat(s["done"], F.array(s["text"])).alias("done"))).otherwise(
            F.struct(F.when(s["text"] == "", x["s"]).otherwise(F.concat(s["text"], F.lit(" "), x["s"])).alias("text"), (s["words"] + x["n"]).alias("words"), s["done"].alias("done"))
        )

    sized = F.transform(listed, lambda x: F.struct(x.alias("s"), F.size(words(x)).alias("n")))
    return F.aggregate(sized, empty, add, lambda s: F.concat(s["done"], F.array(s["text"])))


def _pieces(text: Column, most: int) -> Column:
    """Paragraphs, and sentence-aligned pieces of those over ``most`` words: text, words, whole (a paragraph), lead (its first piece), skip (code points to the next paragraph, at its last piece)."""

    def piece(x, n, whole, lead, skip):
        return F.struct(x.alias("text"), n.cast("int").alias("words"), whole.alias("whole"), lead.alias("lead"), skip.cast("int").alias("skip"))

    def of(part: Column, gap: Column) -> Column:
        skip = F.length(part) + F.length(F.coalesce(gap, F.lit("")))

        def split(bare: Column) -> Column:
            n = F.size(words(bare))

            def cut(pieces: Column) -> Column:
                return F.transform(pieces, lambda p, i: piece(p, F.size(words(p)), F.lit(False), i == 0, F.when(i == F.size(pieces) - 1, skip).otherwise(0)))

            alone = F.array(piece(bare, n, F.lit(True), F.lit(True), skip))
            return F.when(n > most, let(let(sentences(bare), lambda s: F.when(F.size(s) <= 1, F.array(bare)).otherwise(_packed(s, most))), cut)).otherwise(alone)

        return let(strip(part), split)

    parts, gaps = F.split(text, "\n\n+"), F.regexp_extract_all(text, F.lit("\n\n+"), F.lit(0))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), gaps.alias("g")), lambda x: of(x["p"], x["g"])))


def _tail(text: Column, overlap: int) -> Column:
    """The last sentences of a chunk within ``overlap`` words, at least one: struct(text, words)."""

    def of(listed: Column) -> Column:
        def fitting(sizes: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, b: a + b))
            k = let(sums, lambda c: F.greatest(F.lit(1), F.size(F.filter(c, lambda n: n <= overlap))))
            return let(k, lambda k: F.struct(F.array_join(F.slice(listed, F.size(listed) - k + 1, k), " ").alias("text"), F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, b: a + b).alias("words")))

        return let(F.reverse(F.transform(listed, lambda s: F.size(words(s)))), fitting)

    # only sentences near the end can be in it: more words than the overlap follow every other one
    return let(F.slice(F.reverse(sentences(text)), 1, overlap + 1), lambda last: of(F.reverse(last)))


def semantic_chunks(text: Column, most: int = 500, overlap: int = 50) -> Column:
    """Chunks of whole paragraphs or, of longer ones, whole sentences, of at most ``most`` words where sentences allow.

    A chunk after the first begins with the last sentences of the one before, up to ``overlap`` words but at
    least one sentence. Array of struct(text, start, end, words): ``start`` is where its own first piece begins, ``end``
    where the next chunk's does, or the text's length. Null and blank texts have none. One fold over the
    pieces, whose state holds the open chunk; every piece is copied once or twice.
    """
    chunk = "struct<text: string, start: int, end: int, words: int>"
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("at"), F.lit("").alias("text"), F.lit(0).alias("words"), F.lit(0).alias("start"), F.array().cast(f"array<{chunk}>").alias("done"))

    def closed(s: Column, end: Column) -> Column:
        return F.struct(strip(s["text"]).alias("text"), s["start"].alias("start"), end.cast("int").alias("end"), s["words"].alias("words"))

    def state(pos, at, text_, words_, start_, done):
        return F.struct(pos.cast("int").alias("pos"), at.cast("int").alias("at"), text_.alias("text"), words_.cast("int").alias("words"), start_.cast("int").alias("start"), done.alias("done"))

    def add(s: Column, p: Column) -> Column:
        pos = s["pos"] + p["skip"]

        def placed(begin: Column) -> Column:
            at = begin + F.length(p["text"])
            fresh = F.concat(s["done"], F.array(closed(s, begin)))
            plain = state(pos, at, F.when(s["text"] == "", p["text"]).otherwise(F.concat(s["text"], F.lit(" "), p["text"])), s["words"] + p["words"], F.when(s["text"] == "", begin).otherwise(s["start"]), s["done"])
            if overlap > 0:
                cut = let(_tail(s["text"], overlap), lambda t: state(pos, at, F.concat(t["text"], F.lit(" "), p["text"]), t["words"] + p["words"], begin, fresh))
            else:
                cut = state(pos, at, p["text"], p["words"], begin, fresh)
            return F.when((s["text"] != "") & (s["words"] + p["words"] > most), cut).otherwise(plain)

        after = F.when(p["lead"], s["pos"]).otherwise(s["at"])
        found = F.when(p["whole"], s["pos"]).otherwise(let(after, lambda a: let(F.call_function("locate", p["text"], text, a + 1), lambda i: F.when(i > 0, i - 1).otherwise(a))))
        return F.when(p["text"] == "", state(pos, s["at"], s["text"], s["words"], s["start"], s["done"])).otherwise(let(found, placed))

    whole = F.aggregate(_pieces(text, most), start, add, lambda s: F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(closed(s, F.length(text))))))
    return F.coalesce(whole, F.array().cast(f"array<{chunk}>"))

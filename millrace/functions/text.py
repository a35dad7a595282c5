"""Text functions as column expressions: cleaning, grading, readability, language, redaction, tokens.

Java patterns carry ``(?U)`` where classes must cover Unicode. A null text counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.passages import let

# Fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"))
URLS = r"https?://\S+|www\.\S+"
EMAILS = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
PHONES = r"[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]"
BOILERPLATE = (
    r"cookie (policy|notice|consent)", r"privacy policy", r"terms of (service|use)", r"copyright [0-9]{4}", r"all rights reserved", r"subscribe to (our )?newsletter", r"sign up for (our )?newsletter",
    r"follow us on", r"share (this|on)", r"related (articles|posts|content)", r"read more", r"click here", r"advertisement", r"sponsored (content|link)",
)
SENTENCE_ENDS = r"[.!?。！？\n]+"
STRUCTURAL_TAGS = r"(?i)<(html|head|body|script|style|title|meta|link|noscript)\b"
CJK_PUNCTUATION = "、。，；：！？（）【】《》“”‘’—…·￥"
WORD = r"(?U)\b\w+\b"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


#: White space as Unicode has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(t: Column) -> Column:
    """Without white space at both ends: only these are looked at, whatever the text's length."""
    return F.btrim(t, F.lit(SPACES))


def remove_tags(t: Column) -> Column:
    return F.regexp_replace(text_or_empty(t), "<[^>]+>", "")


def decode_entities(t: Column) -> Column:
    """Entities replaced one after another, so a doubly escaped one is decoded twice."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, text_or_empty(t))


def collapse(t: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(t), r"(?U)\s+", " "))


def keep_plain(t: Column, keep: str = "") -> Column:
    """ASCII letters and digits, white space and the characters of ``keep``."""
    escaped = "".join("\\" + c for c in keep)
    return F.regexp_replace(text_or_empty(t), rf"(?U)[^a-zA-Z0-9\s{escaped}]", "")


def remove_contacts(t: Column) -> Column:
    """Without URLs, then e-mail addresses, then phone numbers."""
    for pattern in (URLS, EMAILS, PHONES):
        t = F.regexp_replace(text_or_empty(t), pattern, "")
    return t


def truncate(t: Column, most: int, suffix: str = "...") -> Column:
    t = text_or_empty(t)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - len(suffix)), F.lit(suffix)))


def pieces(t: Column, pattern: str) -> Column:
    """The stripped, non-empty parts between matches."""
    return F.filter(F.transform(F.split(t, pattern), strip), lambda x: x != "")


def readable_ratio(t: Column) -> Column:
    """Share of letters, digits, punctuation and white space; 0 for the empty text. Printable ASCII, all of it readable, is taken out by a cheap pattern first."""
    n = F.length(t)
    rest = F.regexp_replace(t, r"[ -~\t\n\r]+", "")
    bad = F.length(F.regexp_replace(rest, rf"(?U)[\p{{L}}\p{{N}}{CJK_PUNCTUATION}]+", ""))
    return F.when(n > 0, (n - bad) / n).otherwise(0.0)


def cjk_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[一-鿿]"))


def sentence_floor(t: Column) -> Column:
    """Least mean sentence length of prose: 30 characters, 12 in CJK text, between them by share."""
    ratio = cjk_count(t) / F.greatest(F.length(t), F.lit(1))
    return F.round(30.0 * (1 - ratio) + 12.0 * ratio, 1)


def assessment(t: Column) -> Column:
    """Struct of grade (empty, garbled, thin, usable), chars, sentences and avg_sentence_chars of a text's shape.

    Each measure is taken once, and only of texts that those before have not settled.
    """

    def graded(body: Column, m: Column, s: Column) -> Column:
        mean = F.when(s["count"] > 0, s["total"] / s["count"]).otherwise(0.0)
        grade = F.when(m["chars"] < 200, "empty").when(m["readable"] < 0.85, "garbled").when(m["tags"] >= 2, "thin").when(m["chars"] >= 2000, "usable").when(mean >= sentence_floor(body), "usable").otherwise("thin")
        return F.struct(grade.alias("grade"), m["chars"].alias("chars"), s["count"].alias("sentences"), mean.alias("avg_sentence_chars"))

    def shaped(body: Column, m: Column) -> Column:
        lengths = F.when(m["tags"] < 2, F.transform(pieces(body, SENTENCE_ENDS), F.length)).otherwise(F.array().cast("array<int>"))
        sums = let(lengths, lambda x: F.struct(F.size(x).alias("count"), F.aggregate(x, F.lit(0), lambda a, n: a + n).alias("total")))
        return let(sums, lambda s: graded(body, m, s))

    def measured(body: Column) -> Column:
        chars = F.length(body)
        readable = F.struct(chars.alias("chars"), F.when(chars >= 200, readable_ratio(body)).otherwise(0.0).alias("readable"))
        tags = lambda m: F.when(m["readable"] >= 0.85, F.regexp_count(body, F.lit(STRUCTURAL_TAGS))).otherwise(2)
        return let(let(readable, lambda m: F.struct(m["chars"].alias("chars"), m["readable"].alias("readable"), tags(m).alias("tags"))), lambda m: shaped(body, m))

    return let(strip(text_or_empty(t)), measured)


def word_count(t: Column) -> Column:
    """Words and, beside them, each CJK character."""
    return F.regexp_count(t, F.lit(WORD)) + cjk_count(t)


def sentence_count(t: Column) -> Column:
    return F.size(pieces(t, r"[.!?。！？]+"))


def paragraph_count(t: Column) -> Column:
    return F.size(pieces(t, "\n\n"))


def syllables(t: Column) -> Column:
    """Vowel groups of every word, one less for a final e, at least one."""
    words = F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        groups = F.regexp_count(w, F.lit("[aeiouy]+"))
        return F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0))

    return F.aggregate(words, F.lit(0), lambda s, w: s + of(w))


def reading_ease(words: Column, sentences: Column, syllables_: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables_ / words)))


def grade_level(words: Column, sentences: Column, syllables_: Column) -> Column:
    return 0.39 * (words / sentences) + 11.8 * (syllables_ / words) - 15.59


def boilerplate_hits(t: Column) -> Column:
    low = F.lower(t)
    return reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in BOILERPLATE])


def tokens_estimate(t: Column) -> Column:
    """About how many model tokens: four characters each, CJK one and a half; at least one, none of the empty text."""
    t = text_or_empty(t)
    cjk = cjk_count(t)
    return F.when(F.length(t) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(t) - cjk) / 4 + cjk / 1.5))).cast("long")


def script_language(t: Column) -> Column:
    """The first script with more than ten characters, else English where there is a Latin letter."""
    n = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(n(r"[一-鿿]") > 10, "zh").when(n(r"[぀-ゟ゠-ヿ]") > 10, "ja").when(n(r"[가-힯]") > 10, "ko").when(n(r"[Ѐ-ӿ]") > 10, "ru").when(t.rlike("[a-zA-Z]"), "en").otherwise("unknown")
    )


def windows(t: Column, limit: int) -> Column:
    """Consecutive windows of a text: start, has_more, next_start, remaining."""
    n = F.length(t)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(limit))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(t, s + 1, F.lit(limit)).alias("part"), (s + limit < n).alias("has_more"), F.least(s + limit, n).alias("next_start"), F.greatest(n - s - limit, F.lit(0)).alias("remaining")))

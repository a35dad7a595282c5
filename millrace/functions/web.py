"""URLs and pages as column expressions: hosts, identity keys, page text, page metrics, sensitive data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not name a page.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_cid", "utm_reader", "utm_referrer",
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsctatracking",
)
# Query parameters that search results are compared without, and marks of paid placements.
RESULT_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
AD_MARKERS = ("/y.js?", "ad_domain=", "ad_provider=", "ad_type=", "click_metadata=", "/aclk?", "googleadservices", "doubleclick.net", "bing.com/aclick")
#: Sensitive kinds: pattern and the group that is masked, 0 for the whole match. Fixed values.
SENSITIVE = {
    "api_key": (r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["']?([a-zA-Z0-9_\-]{6,})["']?""", 1),
    "password": (r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["']?([^\s"']{6,})["']?""", 1),
    "token": (r"""(?i)(?:token|auth[_-]?token|access[_-]?token|secret)\s*[:=]\s*["']?([a-zA-Z0-9_\-]{6,})["']?""", 1),
    "bearer": (r"(?i)bearer\s+([a-zA-Z0-9_\-\.]{6,})", 1),
    "github_token": (r"gh[pousr]_[A-Za-z0-9]{36}", 0),
    "aws_key": (r"AKIA[0-9A-Z]{16}", 0),
    "aws_secret": (r"""(?i)aws[_-]?secret\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})["']?""", 1),
    "private_key": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0),
    "credit_card": (r"\b(?:\d[ -]*?){13,16}\b", 0),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", 0),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
    "phone": (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0),
}


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))


def identity_key(url: Column) -> Column:
    """The page's identity: scheme and host lower-cased, fragment, credentials and tracking parameters gone, all else kept in order. Empty without a host."""
    part = lambda p, g=1: F.regexp_extract(url, p, g)
    scheme, authority = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), F.lower(part(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)"))
    path, query = part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), part(r"^[^?#]*\?([^#]*)")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)), "&")
    return F.when(authority == "", "").otherwise(F.concat(scheme, F.lit("://"), authority, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def page_text(html: Column) -> Column:
    """Scripts and styles deleted, tags to blanks, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"(?U)\s+", " "))


def counted(html: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(pattern))


def seo(html: Column, base: Column) -> dict[str, Column]:
    """Twelve metrics of a page's markup by patterns alone."""
    html = F.coalesce(html, F.lit(""))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    description = F.trim(F.regexp_extract(html, r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1))
    links = F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href=["']([^"']*)["']"""), F.lit(1)), lambda h: ~h.rlike("^(#|mailto:|tel:|javascript:)"))
    absolute = lambda h: h.rlike("^(https?:)?//")
    inside = lambda h: ~absolute(h) | ((host(base) != "") & F.contains(h, host(base)))
    images = F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]*>"), F.lit(0))
    low = F.lower(html)
    return {
        "title_length": F.length(title), "meta_description_length": F.length(description), "heading_count": counted(html, r"(?i)<h[12][\s>]"), "h1_count": counted(html, r"(?i)<h1[\s>]"),
        "image_count": F.size(images), "images_with_alt": F.size(F.filter(images, lambda i: i.rlike(r"""(?i)\balt=["'][^"']+"""))),
        "internal_links": F.size(F.filter(links, inside)), "external_links": F.size(F.filter(links, lambda h: ~inside(h))),
        "has_schema": F.contains(low, F.lit("application/ld+json")) | F.contains(low, F.lit("itemtype")), "has_og_tags": low.rlike("property=[\"']og:"), "has_twitter_cards": low.rlike("name=[\"']twitter:"),
        "canonical_url": F.regexp_extract(html, r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["']""", 1),
    }


def links(html: Column) -> Column:
    """All link targets of a page in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a[^>]+href=["']([^"']*)["']"""), F.lit(1))


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page: absolute, scheme-relative, root-relative, else relative to the page's folder."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z]+):", 1), F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+(?:/[^?#]*/)?)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), href))
    )


def link_kind(href: Column) -> Column:
    low = F.lower(href)
    return F.when(low.startswith("https:"), "https").when(low.startswith("http:"), "http").when(low.startswith("mailto:"), "mail").when(low.startswith("tel:"), "phone").when(low.startswith("#"), "fragment").otherwise("relative")


def sensitive_counts(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for kind, (p, _) in SENSITIVE.items()}


#: Most stars of a masked value.
STARS = 8


def mask_steps() -> list[tuple[str, int, bool]]:
    """(pattern, stars, whether groups 1 and 2 stay around them) in turn.

    A match, or its named part, gets eight stars, or as many as it has characters where these are fewer.
    """
    steps = []
    for pattern, group in SENSITIVE.values():
        if not group:
            steps.append((pattern, STARS, False))
            continue
        flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        at = body.index("([")
        kind, least = body[at + 1 : body.index("})", at)].rsplit("{", 1)
        if least == "6,":
            steps.append((f"{flags}({body[:at]}){kind}{{{STARS},}}()", STARS, True))
            steps += [(f"{flags}({body[:at]}){kind}{{{size}}}({_beyond(kind)})", size, True) for size in (7, 6)]
        else:
            steps.append((f"{flags}({body[:at]}){kind}{{{least}}}()", STARS, True))
    return steps


def _beyond(kind: str) -> str:
    """A character outside the class, or the end."""
    return (f"[{kind[2:]}" if kind.startswith("[^") else f"[^{kind[1:]}") + "|$"


def masked(text: Column) -> Column:
    """The text with every kind starred in turn (see ``mask_steps``)."""
    out = F.coalesce(text, F.lit(""))
    for pattern, stars, grouped in mask_steps():
        out = F.regexp_replace(out, pattern, f"$1{'*' * stars}$2" if grouped else "*" * stars)
    return out


def result_key(url: Column) -> Column:
    """The key that search results are compared by: scheme and bare host, path without final slashes, first values of untracked parameters by name."""
    url = F.coalesce(url, F.lit(""))
    part = lambda p: F.regexp_extract(url, p, 1)
    scheme, path, query = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):")), part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"), part(r"^[^?#]*\?([^#]*)")
    given = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.transform(given, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(pairs, lambda x: x["k"]), lambda k: ~F.lower(k).isin(*RESULT_TRACKING))))
    clean = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.filter(pairs, lambda x: x["k"] == k)[0]["v"])), "&")
    return F.concat(scheme, F.lit("://"), host(url), F.rtrim(path, F.lit("/")), F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""))


def request_url(url: Column) -> Column:
    """A URL as it is fetched: scheme (https if there is none) and authority lower-cased, default ports and fragments gone, slashes not doubled, a path at least."""
    url = F.trim(F.coalesce(url, F.lit("")))
    part = lambda p: F.regexp_extract(url, p, 1)
    scheme = F.coalesce(F.nullif(F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):")), F.lit("")), F.lit("https"))
    authority = F.lower(part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path, query = F.regexp_replace(part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"), "/+", "/"), part(r"^[^?#]*\?([^#]*)")
    return F.concat(scheme, F.lit("://"), authority, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def sponsored(url: Column) -> Column:
    """Whether a result's URL is a paid placement."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return reduce(lambda a, m: a | F.contains(low, F.lit(m)), AD_MARKERS, F.lit(False))

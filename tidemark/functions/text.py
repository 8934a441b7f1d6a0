"""String functions: tokens, similarity, boilerplate and junk rules, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the token set.
STOP_WORDS = (
    "the a an in on at to of for and or but is are was were be been has have had its that this with by from as after amid over into also not new says said two three"
).split()

#: Path segments of pages that aren't articles.
NON_ARTICLE_SEGMENTS = (
    "people staff contact contact-us author authors tag tags category categories about about-us topic topics advisor for-media press media-center"
).split()

#: Titles of paywalls and error pages, phrases of subscription walls.
JUNK_TITLE = (
    r"^\s*(subscribe|sign.?in|log.?in|register)\b|\b(access denied|forbidden|page not found|are you a robot|attention required|just a moment"
    r"|enable (javascript|cookies)|captcha|client challenge|crossword|sudoku)\b|^\s*(404|403|401)\b"
)
PAYWALL = (
    r"subscribe to (?:unlock|read|continue)|to (?:continue|keep) reading|(?:try|for) unlimited access|unlimited digital access"
    r"|already a subscriber|available exclusively to (?:\w+ )?subscribers|this (?:article|content|story) is (?:for|available to|exclusive)"
    r"|sign in to read|become a (?:member|subscriber)"
)
PAYWALL_POSITION, GOOD_BODY_CHARS = 0.6, 600

#: What words add to a severity.
CASUALTIES = r"\b(\d[\d,]*)\s+(?:people\s+|persons\s+)?(?:dead|killed|deaths|died|injured|wounded|missing|feared dead)\b"
MAGNITUDE = r"\bmagnitude[- ](\d(?:\.\d)?)\b"
ESCALATION = r"\b(?:invasion|state of emergency|mass casualt\w*|catastroph\w*|unprecedented|historic|nuclear|declaration of war|martial law)\b"
ROUTINE = r"\b(?:opinion|analysis|review|interview|preview|explainer|op-ed)\b:?"


def tokens(text: Column) -> Column:
    """The distinct lower-case ASCII words of over two characters that aren't stop words; null text gives none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, the commonest entities their characters, white space one blank."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return collapse(s)


def url_path(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$", 1))


def is_non_article_url(url: Column) -> Column:
    """Root pages, index pages and image assets by their path alone."""
    segments = F.split(url_path(url), "/")
    return (url_path(url) == "") | F.arrays_overlap(segments, F.array(*map(F.lit, NON_ARTICLE_SEGMENTS))) | F.element_at(segments, -1).rlike(r"^\d+x\d+(?:[_-]|$)")


def is_junk_article(title: Column, url: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    hexes = r"^\s*[0-9A-Fa-f]{8}\s+[0-9A-Fa-f]{4}\s+[0-9A-Fa-f]{4}\s+[0-9A-Fa-f]{4}\s+[0-9A-Fa-f]{3,12}\s*$"
    return (t == "") | t.rlike(r"(?i)^\s*https?://") | t.rlike(hexes) | t.rlike("(?i)" + JUNK_TITLE) | is_non_article_url(url)


def is_paywall(text: Column) -> Column:
    """The first subscription phrase begins within the leading 60 % of the text."""
    at = F.regexp_instr(text, F.lit("(?i)" + PAYWALL))
    return F.coalesce((at > 0) & (at - 1 <= F.length(text) * PAYWALL_POSITION), F.lit(False))


def is_good_body(text: Column) -> Column:
    return F.coalesce((F.length(text) >= GOOD_BODY_CHARS) & ~is_paywall(text), F.lit(False))


def is_boilerplate(paragraph_html: Column) -> Column:
    """Empty; or short without the end of a sentence; or mostly the text of links."""
    plain = strip_html(paragraph_html)
    links = F.array_join(F.transform(F.regexp_extract_all(paragraph_html, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), lambda a: F.regexp_replace(a, r"(?s)<[^>]+>", " ")), " ")
    return (plain == "") | ((F.length(plain) < 15) & ~plain.rlike(r"[.!?]\s*$")) | ((F.length(plain) <= 200) & (links != "") & (F.length(links) / F.length(plain) >= 0.6))


def summary(text: Column, sentences: int = 3, chars: int = 350) -> Column:
    """Leading sentences, while they fit; the first one always, cut to size."""
    parts = F.slice(F.split(collapse(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), 1, sentences)

    def add(acc: Column, s: Column) -> Column:
        stop = acc["full"] | ((acc["out"] != "") & (F.length(acc["out"]) + F.length(s) + 1 > chars))
        return F.struct(F.when(stop, acc["out"]).otherwise(F.trim(F.concat_ws(" ", acc["out"], s))).alias("out"), stop.alias("full"))

    return F.substring(F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), add)["out"], 1, chars)


def slug(name: Column, chars: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, chars)


def title_of_slug(url: Column) -> Column:
    """A headline from the last path segment: hyphens become blanks, words get capitals."""
    last = F.element_at(F.split(url_path(url), "/"), -1)
    return title_case(F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]{2,5}$", ""), "[-_]+", " ")))


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital, also after digits and apostrophes."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def strip_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(\s*\([^()]{1,80}\)\s*)+$", ""))


def lexical_severity(text: Column) -> Column:
    """What words alone add to a prior intensity: casualties, magnitudes, escalation, routine framing of the title."""
    counts = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + CASUALTIES), F.lit(1)), lambda m: F.replace(m, F.lit(","), F.lit("")).cast("double"))
    worst, quake = F.array_max(counts), F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + MAGNITUDE), F.lit(1)), lambda m: m.cast("double")))
    return (
        F.when(worst >= 100, 0.25).when(worst >= 10, 0.15).when(worst.isNotNull(), 0.05).otherwise(0.0)
        + F.when(quake >= 7, 0.25).when(quake >= 6, 0.15).otherwise(0.0)
        + F.when(text.rlike("(?i)" + ESCALATION), 0.1).otherwise(0.0)
        - F.when(F.substring(text, 1, 80).rlike("(?i)" + ROUTINE), 0.15).otherwise(0.0)
    )

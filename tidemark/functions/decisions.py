"""Predicates and decisions of the pipeline's stages, of feeds, quotes, forecasts and the map, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import places
from .text import is_boilerplate, is_good_body, is_paywall, strip_html

CLAIM_HOURS, FRESH_HOURS, EVENT_HOURS, BODY_CHARS = 6, 6, 168, 4_000

#: Sources whose pages can't be read, so that a bad text of theirs stays bad.
UNREADABLE_SOURCES = ("ft-world", "wsj-markets", "economist-finance", "project-syndicate")

#: What a section heading contains, and the category that follows; the first one counts.
SECTION_CATEGORY = [
    ("armed", "conflict"), ("conflict", "conflict"), ("war", "conflict"), ("attack", "conflict"), ("terrorism", "conflict"), ("military", "conflict"), ("insurgency", "conflict"),
    ("protest", "protest"), ("demonstration", "protest"), ("unrest", "protest"), ("riot", "protest"),
    ("disaster", "disaster"), ("accident", "disaster"), ("environment", "disaster"), ("health", "disaster"), ("epidemic", "disaster"), ("pandemic", "disaster"), ("earthquake", "disaster"), ("flood", "disaster"),
    ("politic", "political"), ("election", "political"), ("diplomat", "political"), ("international", "political"), ("relation", "political"), ("governance", "political"), ("government", "political"), ("sanction", "political"),
    ("business", "economic"), ("economic", "economic"), ("finance", "economic"), ("trade", "economic"), ("market", "economic"), ("energy", "economic"),
    ("crime", "crime"), ("law", "crime"), ("justice", "crime"), ("corruption", "crime"),
]

#: Endings of image addresses; colours of an earthquake's alert.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
ALERT_COLOURS = {"red": "#e05252", "orange": "#e09652", "yellow": "#e0c852", "green": "#52c8a0"}
TSUNAMI_COLOUR, PLAIN_COLOUR = "#e05252", "#7c6ef8"

#: Parts of a page that aren't its text.
CHROME_TAG = r"(?is)<(nav|header|footer|aside)\b[^>]*>.*?</\1>"
#: Names that classes and ids of chrome hold.
CHROME_NAMES = (
    "nav|menu|sidebar|breadcrumb|cookie|subscribe|newsletter-signup|social-share|share-bar"
    "|related-(?:links|articles|content)|advert|promo|byline-social|site-header|site-footer|masthead"
)
CHROME_CLASS = rf"""(?is)<(\w+)(?=[^>]*\b(?:class|id)\s*=\s*["'][^"']*(?:{CHROME_NAMES})[^"']*["'])[^>]*>.*?</\1>"""


# Stages


def article_stages(stage: Column, queued: Column, created: Column, deferred: Column, backfill: Column, now: Column) -> Column:
    """struct<free, analyze, annotate, refine>: whether an article's claim is free (none, or over 6 hours old), and which
    stages it waits for. Times in seconds; a null mark is false. Fetched articles are analysed while fresh and annotated
    once they aren't, or if they are of a backfill."""
    mine = ~F.coalesce(deferred, F.lit(False))
    free = mine & (queued.isNull() | (queued < now - CLAIM_HOURS * 3_600))
    fresh, old = created >= now - FRESH_HOURS * 3_600, F.coalesce(backfill, F.lit(False))
    waits = (stage == "fetched") & free
    return F.struct(free.alias("free"), (waits & fresh & ~old).alias("analyze"), (waits & (old | ~fresh)).alias("annotate"), (mine & (stage == "refine")).alias("refine"))


def needs_tagging(topics: Column, source: Column) -> Column:
    """topics as JSON text: none, empty or a list of the old form; or what keywords alone have told."""
    text = F.trim(F.coalesce(topics, F.lit("")))
    return (text.isin("", "{}", "null")) | text.startswith("[") | F.coalesce(source == "keyword", F.lit(False))


def event_stages(started: Column, topics: Column, source: Column, routed: Column, now: Column) -> Column:
    """struct<tag, route>: events of the last week that wait for topics or for symbols."""
    live = started >= now - EVENT_HOURS * 3_600
    return F.struct((live & ~F.coalesce(source == "embed", F.lit(False)) & needs_tagging(topics, source)).alias("tag"), (live & F.coalesce(~routed, F.lit(False))).alias("route"))


def at_stage(articles: DataFrame, value: str | None) -> DataFrame:
    """Articles at a stage; `unlocated`: annotated or refined without a place; without a value all."""
    if value == "unlocated":
        return articles.where(F.col("stage").isin("annotated", "refined") & F.col("location").isNull())
    return articles.where(F.col("stage") == value) if value else articles


def at_gap(events: DataFrame, value: str | None) -> DataFrame:
    """Events that miss topics (untagged), have only those of keywords (keyword), or no symbols (unrouted)."""
    gaps = {"untagged": F.col("topics_source") == "", "keyword": F.col("topics_source") == "keyword", "unrouted": ~F.col("is_routed")}
    return events.where(gaps[value]) if value in gaps else events


def in_scope(articles: DataFrame, scope: str) -> DataFrame:
    """What a reprocessing of that scope annotates."""
    scopes = {"deferred": F.col("annotation_deferred") & F.col("processed_on").isNull(), "unfinished": F.col("stage") == "fetched", "everything": F.lit(True)}
    return articles.where(scopes[scope])


def stage_health(pending: Column, last: Column, every_minutes: Column, now: Column) -> Column:
    """Whether a stage is well: nothing waits, it never ran, or it ran within three times its cadence."""
    return ~F.coalesce((pending > 0) & (last < now - 3 * every_minutes * 60), F.lit(False))


def provider_health(last_ok: Column, last_error: Column, window_hours: int, now: Column) -> Column:
    """Whether a provider is well: not tried within the window without a success in it."""
    cutoff = now - window_hours * 3_600
    return ~(F.coalesce(last_error >= cutoff, F.lit(False)) & ~F.coalesce(last_ok >= cutoff, F.lit(False)))


def run_status(status: Column, started: Column, now: Column, limit_hours: int) -> Column:
    """Runs that still say running after the time limit have failed."""
    return F.when((status == "running") & (started < now - limit_hours * 3_600), "failed").otherwise(status)


# Pages and feeds


def body_of(html: Column, most_chars: int = 200_000) -> Column:
    """The paragraphs of a page's article that aren't chrome, up to 4,000 characters; null for a wall or for nothing. A
    chrome element ends at the first end tag of its name. Only the first `most_chars` characters of a page are read: these
    rules stand in where the blocks of the whole page (sources.html.main_text) give nothing."""
    page = F.regexp_replace(F.substring(html, 1, most_chars), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    page = F.regexp_replace(F.regexp_replace(page, CHROME_TAG, " "), CHROME_CLASS, " ")
    main = r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>"
    page = F.when(page.rlike(main), F.regexp_extract(page, main, 1)).otherwise(page)
    paragraphs = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: ~is_boilerplate(p))
    text = F.trim(F.array_join(F.transform(paragraphs, strip_html), " "))
    return F.nullif(F.substring(F.when(~is_paywall(text), text), 1, BODY_CHARS), F.lit(""))


def rehydration(content: Column, source: Column, url: Column) -> Column:
    """skip (no address), keep (good already), delete (its source can't be read) or fetch."""
    return F.when(F.coalesce(url, F.lit("")) == "", "skip").when(is_good_body(content), "keep").when(source.isin(*UNREADABLE_SOURCES), "delete").otherwise("fetch")


def section_category(heading: Column) -> Column:
    out = F.lit("general")
    for keyword, category in reversed(SECTION_CATEGORY):
        out = F.when(F.contains(F.lower(heading), F.lit(keyword)), category).otherwise(out)
    return out


def image_of(contents: Column, thumbnails: Column, enclosures: Column) -> Column:
    """The first usable address: of content that is an image, or of no stated medium with an image's ending; of a
    thumbnail; of an enclosure of an image type. contents: array<struct<url, medium>>, thumbnails: array<struct<url>>,
    enclosures: array<struct<type, href>>."""
    ends = lambda url: F.lower(F.substring_index(url, "?", 1)).rlike("(" + "|".join(e.replace(".", r"\.") for e in IMAGE_ENDINGS) + ")$")
    there = lambda url: F.coalesce(url, F.lit("")) != ""
    medium = lambda m: F.coalesce(m["medium"], F.lit(""))
    content = F.filter(contents, lambda m: there(m["url"]) & ((medium(m) == "image") | ((medium(m) == "") & ends(m["url"]))))
    thumbnail = F.filter(thumbnails, lambda t: there(t["url"]))
    enclosure = F.filter(enclosures, lambda e: F.coalesce(e["type"], F.lit("")).startswith("image/"))
    return F.coalesce(F.get(content, 0)["url"], F.get(thumbnail, 0)["url"], F.get(enclosure, 0)["href"])


def event_translations(translations: Column, title: Column, location: Column) -> Column:
    """map<language, struct<title, location_name>> of an event from its article's map<language, struct<title, city,
    country>>; what a language lacks is the event's own."""
    place = lambda t: F.array_join(F.filter(F.array(t["city"], t["country"]), lambda p: F.coalesce(p, F.lit("")) != ""), ", ")
    own = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return F.transform_values(translations, lambda _, t: F.struct(own(t["title"], title).alias("title"), own(place(t), location).alias("location_name")))


# Quotes, models, forecasts


def quote(price: Column, previous: Column) -> Column:
    """struct<value, change_pct>: the price, or the one before if there is none or it is zero; null without both."""
    change = F.when(price.isNotNull() & (previous != 0), places((price - previous) / previous * 100, 4))
    return F.when(price.isNotNull() | previous.isNotNull(), F.struct(F.when(F.coalesce(price, F.lit(0.0)) != 0, price).otherwise(previous).alias("value"), change.alias("change_pct")))


def signed_score(scores: Column) -> Column:
    """positive less negative of array<struct<label, score>>, to 4 places; the last score of a label counts."""
    return places(_last_score(scores, "positive") - _last_score(scores, "negative"), 4)


def _last_score(scores: Column, label: str) -> Column:
    return F.coalesce(F.get(F.reverse(F.filter(scores, lambda s: F.lower(s["label"]) == label)), 0)["score"], F.lit(0.0))


def match_confidence(similarity: Column, threshold: float = 0.42) -> Column:
    """From 0.5 at the threshold up to 1, to 3 places; null below it."""
    return F.when(similarity >= threshold, places(F.least(F.lit(1.0), 0.5 + (similarity - threshold)), 3))


def tie_break(best: Column, score: Column, specific: Column, specific_score: Column) -> Column:
    """The best category, but a specific one of 0.30 or more that general beats by 0.04 or less."""
    return F.when((best == "general") & (specific_score >= 0.30) & (score - specific_score <= 0.04), specific).otherwise(best)


def sub_category(best: Column, score: Column, floor: float = 0.25) -> Column:
    return F.when(score >= floor, best).otherwise("other")


def decision(close: Column, p_up: Column, change: Column, residual: Column) -> Column:
    """What a forecast says: direction, price, band and confidence, to 4 places."""
    four = lambda c, name: places(c, 4).alias(name)
    return F.struct(
        four(p_up, "proba_up"), F.when(p_up > 0.55, "up").when(p_up < 0.45, "down").otherwise("neutral").alias("direction"), four(change * 100, "predicted_change_pct"),
        four(close * (1 + change), "predicted_price"), four(close * (1 + change - residual), "band_low"), four(close * (1 + change + residual), "band_high"), four(F.abs(p_up - 0.5) * 2, "confidence"), four(close, "current_value"),
    )


def projection(bars: DataFrame, forecasts: DataFrame, by: str = "symbol", at: str = "d") -> DataFrame:
    """(by, date, close, projection, band): history with its last close as the start of the projection, and the forecast's
    point at as_of plus horizon days. forecasts: one row (by, as_of, horizon_days, predicted_price, band_low, band_high) a
    key; without a price or without bars nothing is projected."""
    last = bars.groupBy(by).agg(F.max(at).alias("_last"))
    there = forecasts.where("predicted_price is not null").join(last, by)
    band = F.when(F.col("band_low").isNotNull() & F.col("band_high").isNotNull(), F.array("band_low", "band_high"))
    history = bars.join(there.select(by, "_last"), by, "left").select(by, F.col(at).alias("date"), "close", F.when(F.col(at) == F.col("_last"), F.col("close")).alias("projection"), F.lit(None).cast("array<double>").alias("band"))
    point = there.select(by, F.date_add("as_of", F.col("horizon_days")).alias("date"), F.lit(None).cast("double").alias("close"), F.col("predicted_price").alias("projection"), band.alias("band"))
    return history.unionByName(point)


# Notices, the map, task records, model calls


def usage_share(total: Column, n: Column, i: Column) -> Column:
    """The part of a batch's tokens that item i (from 0) of n answers for: equal parts, the remainder one each to the first."""
    total = F.coalesce(total, F.lit(0)).cast("long")
    return F.floor(total / n) + F.when(i < total % n, 1).otherwise(0)


def ranked_models(models: DataFrame, excluded: tuple[str, ...] = (), least_context: int = 16_000) -> DataFrame:
    """Free text models (id, prompt_price, completion_price, modalities, context) with context enough, the largest first; a
    null price is free, and null modalities are text. Names that hold an excluded word are left out."""
    free = (F.coalesce("prompt_price", F.lit(0.0)) == 0) & (F.coalesce("completion_price", F.lit(0.0)) == 0)
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    for word in excluded:
        named = named & ~F.contains(F.lower("id"), F.lit(word))
    text = F.contains(F.coalesce("modalities", F.lit("text")), F.lit("text"))
    return models.where(named & free & text & (F.coalesce("context", F.lit(0)) >= least_context)).orderBy(F.desc("context"), "id")


def notice(number: Column, facility: Column, q: Column, fallback: Column, begin: Column, end: Column, now: Column) -> Column:
    """A notice as it is kept: the Q line's place and heights, or the airport's place with a radius of 5 miles; expired if
    its end has passed; null without a number. q: parsing.q_line(); fallback: struct<latitude, longitude>."""
    whole = q.isNotNull() & q["latitude"].isNotNull()
    pick = lambda name, other: F.when(whole, q[name]).otherwise(other)
    return F.when(
        F.coalesce(number, F.lit("")) != "",
        F.struct(
            F.concat(F.coalesce(facility, F.lit("")), F.lit("/"), number).alias("notam_id"), F.when(end < now, "expired").otherwise("active").alias("status"), F.coalesce(begin, now).alias("effective_from"), end.alias("effective_to"),
            pick("latitude", fallback["latitude"]).alias("latitude"), pick("longitude", fallback["longitude"]).alias("longitude"), pick("radius_nm", F.lit(5.0)).alias("radius_nm"), pick("upper_ft", F.lit(None)).alias("altitude_max_ft"),
        ),
    )


def quake_radius(magnitude: Column) -> Column:
    """At least 4; null where a magnitude below 2 has no real power."""
    return F.when(magnitude >= 2, F.greatest(F.lit(4.0), F.floor(F.pow(magnitude - 2, 1.6) + 0.5).cast("double")))


def quake_colour(alert: Column, tsunami: Column) -> Column:
    of_alert = F.lit(PLAIN_COLOUR)
    for name, colour in ALERT_COLOURS.items():
        of_alert = F.when(F.lower(alert) == name, colour).otherwise(of_alert)
    return F.when(tsunami, TSUNAMI_COLOUR).otherwise(of_alert)


def flag_points(country: Column) -> Column:
    """array<int>: the code points of a country code's flag."""
    letters = F.filter(F.split(F.upper(country), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c) + (0x1F1E6 - 65))


def shortened(items: Column, most: int = 20, chars: int = 200) -> Column:
    """An array of strings fit for a task's record: `most` items of `chars` characters, then how many more there are."""
    shown = F.transform(F.slice(items, 1, most), lambda x: F.substring(x, 1, chars))
    more = F.concat(F.lit("...+"), (F.size(items) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(items) > most, F.array_append(shown, more)).otherwise(shown)


def sampled_days(start_year: int, end_year: int, months_per_year: int, now: Column, seed: int) -> Column:
    """array<struct<month, day>>: of evenly spaced months that have begun, a day each, drawn by a seeded hash."""
    step = max(1, 12 // months_per_year)
    starts = [f"{y}-{m:02}-01" for y in range(start_year, end_year + 1) for m in range(1, 13, step)[:months_per_year]]
    begun = F.filter(F.array(*[F.lit(s).cast("date") for s in starts]), lambda d: d < F.to_date(now))
    days = lambda d: F.greatest(F.lit(1), F.datediff(F.least(F.add_months(d, 1), F.to_date(now)), d))
    return F.transform(begun, lambda d: F.struct(d.alias("month"), F.date_add(d, F.pmod(F.datediff(d, F.lit("2000-01-01")) * 7_919 + seed, days(d)).cast("int")).alias("day")))

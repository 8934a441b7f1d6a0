"""Readers of feed formats: XML entries, sitemaps, GeoJSON, rate tables, quotes, front pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_html, url_path
from ..operators.tables import written
from .rss import rss_entries

MIN_ANCHOR_CHARS, MAX_SITEMAPS = 25, 40
QUAKES = "features array<struct<id: string, properties: struct<mag: double, place: string, time: bigint, tsunami: int, alert: string>, geometry: struct<coordinates: array<double>>>>"


def fetch_start(last_fetched: Column, now: Column) -> Column:
    """Where an incremental scan begins: the cursor, a day back at most."""
    floor = now - F.expr("interval 24 hours")
    return F.greatest(F.coalesce(last_fetched, floor), floor)


def urlset(sitemaps: DataFrame, xml: str, start: Column, end: Column) -> DataFrame:
    """(url, published) of the entries of sitemaps in [start, end); the news date counts before lastmod; root pages go."""
    one = lambda tag: F.regexp_extract("_u", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    u = sitemaps.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>.*?</url>"), F.lit(0))).alias("_u"))
    when = lambda tag: F.try_to_timestamp(F.nullif(one(tag), F.lit("")))
    out = u.select(one("loc").alias("url"), F.coalesce(when("news:publication_date"), when("lastmod")).alias("published"))
    return out.where((F.col("published") >= start) & (F.col("published") < end) & (url_path(F.col("url")) != ""))


#: Where sitemaps usually are.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/news-sitemap.xml")


def sitemap_candidates(base: Column, override: Column, robots: Column) -> Column:
    """array<string>: where a source's sitemaps may be, each once: its own address if it has one, those that robots.txt
    names, the usual paths."""
    own = F.when(F.coalesce(override, F.lit("")) != "", F.array(override)).otherwise(F.array().cast("array<string>"))
    named = F.filter(F.transform(F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^sitemap:(.*)$"), F.lit(1)), lambda u: F.trim(u)), lambda u: u != "")
    return F.array_distinct(F.concat(own, named, F.array(*[F.concat(base, F.lit(p)) for p in SITEMAP_PATHS])))


def merged_entries(entries: DataFrame, source: str, url: str, candidate: str, rank: str, first_only: str) -> DataFrame:
    """Entries of all candidates of a source, each URL once, as the first candidate that has it tells it; where first_only
    holds, of the first candidate alone that has entries. candidate: its place in the list, rank: the place in it."""
    best = F.min(F.struct(candidate, rank, *[c for c in entries.columns if c not in (source, url, candidate, rank)])).alias("_e")
    merged = entries.groupBy(source, url).agg(best).select(source, url, "_e.*")
    first = entries.groupBy(source).agg(F.min(candidate).alias("_first"))  # a row per source
    return merged.join(first, source).where(F.col(candidate).eqNullSafe(F.col("_first")) | ~F.coalesce(F.col(first_only), F.lit(False))).drop("_first")


def prune_sitemaps(index: DataFrame, lastmod: str, day: Column, most: int = MAX_SITEMAPS) -> DataFrame:
    """The sitemaps nearest to a day, undated ones last; those last changed over a week before it can't matter."""
    near = F.abs(F.datediff(F.to_date(lastmod), day))
    return index.where(F.col(lastmod).isNull() | (F.datediff(F.to_date(lastmod), day) >= -7)).orderBy(near.asc_nulls_last(), *index.columns).limit(most)


def listed_sitemaps(indexes: DataFrame, xml: str, start: Column, end: Column, most: int = MAX_SITEMAPS) -> DataFrame:
    """(index, url, lastmod) of the sitemaps that each of the indexes (url, document) lists: the `most` nearest to [start, end)
    by when they were last changed, then in their order; undated ones after all dated; those last changed over a week
    before it are left out. Documents that aren't indexes list none; a url listed twice counts once."""
    one = lambda tag: F.nullif(F.regexp_extract("_s", rf"(?s)<(?:\w+:)?{tag}>\s*(.*?)\s*</(?:\w+:)?{tag}>", 1), F.lit(""))
    found = indexes.select(F.col("url").alias("index"), F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?sitemap>.*?</(?:\w+:)?sitemap>"), F.lit(0))).alias("_rank", "_s"))
    s = found.select("index", "_rank", one("loc").alias("url"), F.try_to_timestamp(one("lastmod")).alias("lastmod")).where("url is not null")
    at, first, last = F.unix_timestamp("lastmod"), F.unix_timestamp(start), F.unix_timestamp(end)
    far = F.when(at < first, first - at).when(at >= last, at - last).when(at.isNotNull(), 0)
    s = s.where(at.isNull() | (at >= first - 7 * 86_400)).withColumn("_far", F.coalesce(far, F.lit(1 << 62)))
    best = s.groupBy("index", "url").agg(F.min(F.struct("_far", "_rank", "lastmod")).alias("b"))
    place = F.row_number().over(Window.partitionBy("index").orderBy("b._far", "b._rank"))  # a document's entries
    return best.withColumn("_place", place).where(F.col("_place") <= most).select("index", "url", "b.lastmod")


def reached_sitemaps(stored: DataFrame, xml: str, roots: DataFrame, start: Column, end: Column, most: int = MAX_SITEMAPS, max_depth: int = 10) -> DataFrame:
    """(url, document, depth) of the stored documents (url, document) that roots (url) lead to over indexes of sitemaps, each
    once, at its least depth: the frontier of urls not met before goes on until nothing is new, or max_depth is reached
    (an error, as indexes of indexes have few levels). Cycles end, as what was met isn't taken again; sitemaps that aren't
    stored are passed over."""
    frontier = written(roots.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    met = [frontier]
    for depth in range(1, max_depth + 1):
        listed = listed_sitemaps(stored.join(frontier.select("url"), "url", "left_semi"), xml, start, end, most).select("url").distinct()
        for level in met:
            listed = listed.join(level.select("url"), "url", "left_anti")
        frontier = written(listed.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        met.append(frontier)
    else:
        raise RuntimeError(f"sitemaps lie deeper than {max_depth} levels")
    every = met[0]
    for level in met[1:]:
        every = every.unionByName(level)
    return stored.join(every, "url").select("url", xml, "depth")


def entries_in(stored: DataFrame, xml: str, roots: DataFrame, start: Column, end: Column) -> DataFrame:
    """(url, published) of the entries in [start, end) of all sitemaps that roots lead to, each url once, with its first time."""
    return urlset(reached_sitemaps(stored, xml, roots, start, end), xml, start, end).groupBy("url").agg(F.min("published").alias("published"))


def anchors(pages: DataFrame, html: str = "html", url: str = "url", least: int = MIN_ANCHOR_CHARS) -> DataFrame:
    """Links of front pages with a headline of 25 characters (`least`) or more, in page order, the first of equal ones."""
    found = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["'][^"']*["'][^>]*>.*?</a>"""), F.lit(0))).alias("rank", "_a"))
    a = found.select(*pages.columns, "rank", F.regexp_extract("_a", r"""(?i)href=["']([^"']*)["']""", 1).alias("href"), strip_html(F.col("_a")).alias("anchor"))
    return a.where(F.length("anchor") >= least).groupBy(*[c for c in pages.columns if c not in (html,)], "href").agg(F.min("rank").alias("rank"), F.min_by("anchor", "rank").alias("anchor"))


def first_of(html: Column, *patterns: str) -> Column:
    """The first pattern's group that is there."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def og_image(html: Column) -> Column:
    return first_of(html, r"""(?is)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""", r"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']""")


def quakes(raw: DataFrame, json: str) -> DataFrame:
    """Rows of a GeoJSON feed; those without an id or a time go."""
    f = raw.select(F.explode(F.from_json(json, QUAKES)["features"]).alias("f"))
    g = F.col("f.geometry.coordinates")
    out = f.select(F.col("f.id").alias("usgs_id"), F.col("f.properties.mag").alias("magnitude"), F.timestamp_millis("f.properties.time").alias("occurred_at"), F.try_element_at(g, F.lit(2)).alias("latitude"), F.try_element_at(g, F.lit(1)).alias("longitude"))
    return out.where("usgs_id is not null and occurred_at is not null")


def latest_observation(rates: DataFrame, observations: str) -> DataFrame:
    """Rates are maps from a number in text to a value; the largest number is the latest."""
    best = F.array_max(F.transform(F.map_entries(observations), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))))
    return rates.withColumn("value", best["v"])


def nearest_noon(captures: DataFrame, by: list[str], at: str) -> DataFrame:
    """Per key the capture nearest to noon, the earlier one of equals. With the day in the key, what is nearest lies in that
    day: every capture of another day is farther from its noon."""
    minutes = F.abs(F.hour(at) * 60 + F.minute(at) - 720)
    return captures.groupBy(*by).agg(F.min_by(F.struct(*[c for c in captures.columns if c not in by]), F.struct(minutes, at)).alias("r")).select(*by, "r.*")


def daily_bars(raw: DataFrame, stored: DataFrame | None = None, by: str = "symbol", at: str = "d", back_days: int = 3) -> DataFrame:
    """Bars (by, at, open, high, low, close, volume) to be written: those with a close, other values that aren't numbers
    null, at whole days. With the stored bars only the tail is taken, from three days before the last one of a symbol;
    symbols without stored bars, and a full pull without `stored`, are taken whole."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    bars = raw.where("close is not null and not isnan(close)").select(by, F.to_date(at).alias(at), *[number(c) for c in ("open", "high", "low", "close", "volume")])
    if stored is None:
        return bars
    last = stored.groupBy(by).agg(F.date_sub(F.max(at), back_days).alias("_from"))  # a row per symbol
    return bars.join(last, by, "left").where(f"_from is null or {at} >= _from").drop("_from")


READERS: dict[str, Callable[..., DataFrame]] = {"rss": rss_entries, "sitemap": urlset, "earthquakes": quakes, "front_page": anchors}


def reader(kind: str) -> Callable[..., DataFrame]:
    """The reader of a source type; others raise."""
    if kind not in READERS:
        raise ValueError(f"no reader for sources of type {kind}")
    return READERS[kind]


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixtures."""
    return spark.createDataFrame(rows, schema)

"""Feed documents: entries of RSS and Atom, with namespaces, character data, zone names and media."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_tz
from html.entities import html5
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import image_of
from ..functions.text import collapse, strip_html
from ..operators.tables import map_arrow

MIN_WORDS = 30
_OWN_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_STRINGS = lambda *names: pa.struct([(n, pa.string()) for n in names])
ENTRY = pa.struct([
    ("rank", pa.int32()), ("feed_id", pa.string()), ("title", pa.string()), ("link", pa.string()), ("author", pa.string()), ("content", pa.string()), ("published", pa.int64()),
    ("contents", pa.list_(_STRINGS("url", "medium"))), ("thumbnails", pa.list_(_STRINGS("url"))), ("enclosures", pa.list_(_STRINGS("type", "href"))),
])
ENTRY_SCHEMA = (
    "struct<rank: int, feed_id: string, title: string, link: string, author: string, content: string, published: long, contents: array<struct<url: string, medium: string>>, "
    "thumbnails: array<struct<url: string>>, enclosures: array<struct<type: string, href: string>>>"
)


def seconds_of(text: str | None) -> int | None:
    """A time in seconds: RFC 822 with a zone's name or offset, or ISO; without a zone UTC; anything else is null."""
    if not text or not text.strip():
        return None
    if (parts := parsedate_tz(text)) is not None:
        try:
            return calendar.timegm(parts[:6] + (0, 1, 0)) - (parts[9] or 0)
        except (ValueError, OverflowError):
            return None
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return calendar.timegm((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).utctimetuple())


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


class _Entry:
    """The elements of one entry, by local name; names that other namespaces use too are told apart by theirs."""

    def __init__(self, element: ElementTree.Element) -> None:
        self.parts: dict[str, list[ElementTree.Element]] = {}
        for e in element.iter():
            if e is not element:
                media = "media:" if isinstance(e.tag, str) and "search.yahoo.com/mrss" in e.tag else ""
                self.parts.setdefault(media + _local(e.tag), []).append(e)

    def all(self, name: str) -> list[ElementTree.Element]:
        return self.parts.get(name, [])

    def text(self, *names: str) -> str | None:
        """The text, whole, of the first element of the first of the names that has one."""
        return next((t for name in names for e in self.all(name) if (t := "".join(e.itertext()).strip())), None)

    def links(self, rel: str) -> list[ElementTree.Element]:
        return [e for e in self.all("link") if e.get("href") and (e.get("rel") or "alternate") == rel]

    def row(self, rank: int) -> dict:
        link = next((t for e in self.all("link") if (t := (e.text or "").strip())), None) or next((e.get("href") for e in self.links("alternate")), None)
        link = link or next((e.text for e in self.all("guid") if (e.text or "").startswith("http") and e.get("ispermalink", e.get("isPermaLink", "true")) != "false"), None)
        author = next((t for e in self.all("author") for t in [next(("".join(n.itertext()).strip() for n in e if _local(n.tag) == "name"), None) or "".join(e.itertext()).strip()] if t), None)
        enclosures = [(e.get("type"), e.get("url")) for e in self.all("enclosure")] + [(e.get("type"), e.get("href")) for e in self.links("enclosure")]
        return {
            "rank": rank, "feed_id": self.text("guid", "id") or link, "title": self.text("title"), "link": link, "author": author or self.text("creator"),
            "content": self.text("encoded", "content", "summary", "description"),
            "published": next((s for n in ("pubdate", "published", "date", "issued", "updated", "modified") for e in self.all(n) if (s := seconds_of(e.text)) is not None), None),
            "contents": [{"url": e.get("url"), "medium": e.get("medium")} for e in self.all("media:content")],
            "thumbnails": [{"url": e.get("url")} for e in self.all("media:thumbnail")],
            "enclosures": [{"type": t, "href": h} for t, h in enclosures],
        }


def entries_of(document: str | None) -> list[dict] | None:
    """The entries of a feed document, in order; null if it isn't XML. Entities that HTML names are read as well."""
    if document is None:
        return None
    known = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in _OWN_ENTITIES else html5.get(m[1] + ";", m[0]), _NOT_XML.sub("", document).strip())
    try:
        root = ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", known))
    except ElementTree.ParseError:
        return None
    return [_Entry(e).row(k) for k, e in enumerate(x for x in root.iter() if _local(x.tag) in ("item", "entry"))]


def read_feeds(feeds: DataFrame, xml: str) -> DataFrame:
    """feeds without the document's column, with entries (array, in order), null for documents that can't be read."""
    kept = [c for c in feeds.columns if c != xml]
    numbered = feeds.select(F.struct(*kept).alias("own") if kept else F.lit(None).cast("struct<x: int>").alias("own"), F.col(xml).alias("xml"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entries_of(x) for x in batch.column("xml").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, pa.list_(ENTRY))], ["own", "entries"])

    read = map_arrow(numbered, work, f"own {numbered.schema['own'].dataType.simpleString()}, entries array<{ENTRY_SCHEMA}>")
    return read.select(*[F.col(f"own.`{c}`") for c in kept], "entries")


def rss_entries(feeds: DataFrame, xml: str, start: Column, now: Column) -> DataFrame:
    """Entries of feed documents after start that have a title, a link, content, and 30 words or more in title and content:
    the columns of feeds but the document's, feed_id, title, link, author, content, published_on, image. Without a time of
    its own an entry is of now. Documents that can't be read, and null ones, have no entries."""
    items = read_feeds(feeds, xml)
    own = [c for c in items.columns if c != "entries"]
    e = items.select(*own, F.explode("entries").alias("e"))
    e = e.select(
        *own, "e.feed_id", F.trim("e.title").alias("title"), "e.link", "e.author", strip_html(F.coalesce("e.content", F.lit(""))).alias("content"),
        F.coalesce(F.timestamp_seconds("e.published"), now).alias("published_on"), image_of(F.col("e.contents"), F.col("e.thumbnails"), F.col("e.enclosures")).alias("image"),
    )
    words = F.size(F.split(collapse(F.concat_ws(" ", "title", "content")), " "))
    return e.where((F.col("title") != "") & (F.col("link") != "") & (F.col("content") != "") & (F.col("published_on") > start) & (words >= MIN_WORDS))


def advanced(cursors: DataFrame, feeds: DataFrame, xml: str, now: Column) -> DataFrame:
    """(source, last_fetched) after feeds (source, document) were read: now, for sources all of whose documents could be
    read; the others, and those without a document, keep theirs, so that the next scan takes them from there again."""
    read = read_feeds(feeds, xml).groupBy(F.col("source").alias("s")).agg(F.every(F.col("entries").isNotNull()).alias("ok"))
    joined = cursors.join(read, F.col("source") == F.col("s"), "full_outer")
    return joined.select(F.coalesce("source", "s").alias("source"), F.when(F.col("ok"), now).otherwise(F.col("last_fetched")).alias("last_fetched"))

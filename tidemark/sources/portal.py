"""Pages of dated event lists: headings, named topics with lists below them, and leaves with citations."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import section_category
from ..functions.text import collapse, slug, strip_citations
from ..operators.tables import map_arrow
from .html import Elements

LEAST_CHARS, TOPIC_DEPTH = 20, 2
#: Bytes of a page that are read at once, and items that leave a task at once.
READ_BYTES, BATCH_ITEMS = 1 << 16, 4_096

#: Headings that aren't sections.
SKIPPED = {"contents", "navigation", "references", "notes", "see also", "external links", "further reading", "footnotes"}


class _Items(Elements):
    """The list items of a page, each with its section's heading and the items around it."""

    def __init__(self) -> None:
        super().__init__()
        self.items: list[dict] = []
        self.seq = 0
        self.open: list[dict] = []
        self.divs: list[str] = []
        self.day = self.heading = ""
        self.in_paragraph = False
        self.words: list[str] | None = None  # of a heading that is being read

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        classes = attrs.get("class", "").split()
        if tag == "div":
            self.divs.append("heading" if "current-events-content-heading" in classes else "")
            if "current-events-main" in classes:
                self.day, self.heading = attrs.get("id", ""), ""
            if self.divs[-1]:
                self.words = []
        elif tag == "p":
            self.in_paragraph = not self.open
        elif tag == "b" and self.in_paragraph:
            self.words = []
        elif tag == "ul" and self.open:
            self.open[-1]["nested"] = True
        elif tag == "li":
            self.open.append({"words": [], "cites": [], "nested": False})
        elif tag == "a" and self.open and "external" in classes and attrs.get("href", "").startswith("http"):
            self.open[-1]["cites"].append(attrs["href"])

    def text(self, data: str) -> None:
        if self.words is not None:
            self.words.append(data)
        elif self.open and not self.open[-1]["nested"]:
            self.open[-1]["words"].append(data)

    def closed(self, tag: str) -> None:
        ends_heading = tag == "div" and bool(self.divs) and self.divs.pop() == "heading"
        if self.words is not None and (ends_heading or tag in ("b", "p")):
            text = " ".join("".join(self.words).split())
            if text and text.lower() not in SKIPPED:
                self.heading = text
            self.words = None
        if tag == "p":
            self.in_paragraph = False
        elif tag == "li" and self.open:
            item = self.open.pop()
            above = ["".join(o["words"]).strip() for o in self.open]
            self.items.append({
                "day": self.day, "seq": self.seq, "heading": self.heading, "depth": len(above) + 1, "topics": [t for t in above if t],
                "text": "".join(item["words"]), "cites": item["cites"], "nested": item["nested"],
            })
            self.seq += 1

    def taken(self) -> list[dict]:
        """The items since it was last asked."""
        items, self.items = self.items, []
        return items


def _read(parser: _Items, page: pa.Scalar) -> Iterator[list[dict]]:
    """The items of a page, which is read a piece at a time; what is still open (a long comment) is read again with as
    much more of the page."""
    if (raw := page.cast(pa.large_binary()).as_buffer()) is not None:
        decoder, data, at = codecs.getincrementaldecoder("utf-8")(), memoryview(raw), 0
        while at < len(data):
            end = at + max(READ_BYTES, len(parser.rawdata))
            parser.feed(decoder.decode(data[at:end]))
            at = end
            yield parser.taken()
    parser.end()
    yield parser.taken()


def portal_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, day, seq, heading, depth, topics, text, cites, nested): the list items of pages, also unclosed ones, a page a row of the input; day
    is the id of the part of the page, topics are the items around, text is that before a nested list. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()
    item = [("day", pa.string()), ("seq", pa.int32()), ("heading", pa.string()), ("depth", pa.int32()), ("topics", pa.list_(pa.string())), ("text", pa.string()), ("cites", pa.list_(pa.string())), ("nested", pa.bool_())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []

            def out() -> pa.RecordBatch:
                of = batch.column(key).take(pa.array(keys, pa.int32()))  # noqa: B023
                return pa.RecordBatch.from_arrays([of, *[pa.array([i[c] for i in kept], t) for c, t in item]], ["_key", *[c for c, _ in item]])  # noqa: B023

            for k in range(batch.num_rows):
                for some in _read(_Items(), batch.column(html)[k]):
                    kept += some
                    keys += [k] * len(some)
                    if len(kept) >= BATCH_ITEMS:
                        yield out()
                        keys, kept = [], []
            yield out()

    schema = f"`_key` {kind}, day string, seq int, heading string, depth int, topics array<string>, text string, cites array<string>, nested boolean"
    return map_arrow(pages.select(key, html), work, schema).withColumnRenamed("_key", key)


def portal_events(items: DataFrame) -> DataFrame:
    """Leaves with a citation and 20 characters or more after citations in brackets at their end are gone, with category."""
    leaves = items.where("not nested and size(cites) > 0").withColumn("text", strip_citations(collapse(F.col("text"))))
    return leaves.where(F.length("text") >= LEAST_CHARS).withColumn("category", section_category(F.col("heading")))


def portal_topics(items: DataFrame, at: str) -> DataFrame:
    """(slug, name, category, at) of named topics of the two upper levels; of one slug the latest, by `at`, then its place."""
    named = items.where(F.col("nested") & (F.col("depth") <= TOPIC_DEPTH)).withColumn("name", collapse(F.col("text"))).where("name <> ''")
    last = F.max_by(F.struct("name", section_category(F.col("heading")).alias("category"), at), F.struct(at, "seq"))
    return named.groupBy(slug(F.col("name")).alias("slug")).agg(last.alias("t")).select("slug", "t.*")

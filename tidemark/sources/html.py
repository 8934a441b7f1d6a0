"""HTML as a stream of opened and closed elements, and the main text of pages from their blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import BODY_CHARS, CHROME_NAMES, body_of
from ..functions.text import is_paywall
from ..operators.tables import map_arrow

#: What a parser reads of a page.
PAGE_CHARS = 4_000_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first closes the open elements of the second, up to the nearest of the third.
_CELLS = {"table", "tr", "td", "th", "tbody", "thead", "tfoot"}
IMPLIED = [
    ({"li"}, {"li"}, {"ul", "ol", "menu"} | _CELLS),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"} | _CELLS),
    ({"option", "optgroup"}, {"option"}, {"select"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"tr", "tbody", "thead", "tfoot"}, {"tr", "td", "th"}, {"table"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot"}, {"table"}),
    (BLOCKS - _CELLS | {"table"}, {"p"}, {"td", "th", "caption", "button"}),
]
#: An end tag closes nothing beyond the nearest of these.
_SCOPE = {"li": {"ul", "ol", "menu"} | _CELLS, "p": {"td", "th", "caption", "button"}}


class Elements(HTMLParser):
    """Elements with the end tags that HTML leaves out: opened() and closed() come in pairs, well nested, every element
    being closed at the end of the page; end tags of nothing open are passed over."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []

    def opened(self, tag: str, attrs: dict[str, str]) -> None: ...

    def closed(self, tag: str) -> None: ...

    def text(self, data: str) -> None: ...

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.closed(self.stack.pop())

    def _depth_of(self, tags: set[str], within: set[str]) -> int:
        """How many elements are below the outermost open one of tags that no element of `within` separates; -1: none is open."""
        found = -1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in tags:
                found = k
            elif self.stack[k] in within:
                break
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for starts, ends, within in IMPLIED:
            if tag in starts and (depth := self._depth_of(ends, within)) >= 0:
                self._close_to(depth)
        self.stack.append(tag)
        self.opened(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._close_to(len(self.stack) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements alone

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                self._close_to(k)
                return
            if self.stack[k] in _SCOPE.get(tag, ()):
                return

    def handle_data(self, data: str) -> None:
        self.text(data)

    def read(self, page: str) -> None:
        self.feed(page)
        self.end()

    def end(self) -> None:
        self.close()
        self._close_to(0)


UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "button", "select", "textarea", "iframe"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_CHROME_NAMED = re.compile(rf"(?:^|[\s_-])(?:{CHROME_NAMES})", re.IGNORECASE)
#: A block's weight is its words outside links less LINK_WORD for each inside one, less the price of a block.
LINK_WORD, BLOCK_PRICE = 4, 6


class _Blocks(Elements):
    """The runs of text between block elements, in order: (words outside links, words in links, text, in an article)."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[int, int, str, bool]] = []
        self.hidden: list[bool] = [False]  # of each open element, whether its text is chrome
        self.links = self.articles = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.inside = False

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            linked = len("".join(self.linked).split())
            self.blocks.append((max(len(text.split()) - linked, 0), linked, text, self.inside))
        self.parts, self.linked = [], []
        self.inside = self.articles > 0

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCKS or tag == "br":
            self._end_block() if tag != "br" else self.text(" ")
        named = tag not in ("html", "body", "article", "main") and any(_CHROME_NAMED.search(attrs.get(a, "")) for a in ("class", "id"))
        # A header of an article is its own; others are the site's.
        chrome = tag in CHROME and not (tag == "header" and self.articles)
        self.hidden.append(self.hidden[-1] or tag in UNSEEN or chrome or named)
        self.links += tag == "a"
        self.articles += tag in ("article", "main")
        self.inside = self.inside or self.articles > 0

    def closed(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        self.hidden.pop()
        self.links -= tag == "a"
        if tag in ("article", "main"):
            self.articles -= 1
            self.inside = self.articles > 0

    def text(self, data: str) -> None:
        if not self.hidden[-1]:
            self.parts.append(data)
            if self.links:
                self.linked.append(data + " ")


def main_run(weights: list[int]) -> tuple[int, int]:
    """[first, end) of the run of the greatest sum, the first of equal ones; (0, 0) if none is positive."""
    best, at, total, first = 0, (0, 0), 0, 0
    for k, w in enumerate(weights):
        if total <= 0:
            total, first = 0, k
        total += w
        if total > best:
            best, at = total, (first, k + 1)
    return at


def main_text(page: str) -> str:
    """The page's main text: of the blocks outside chrome, the run whose weights add up to most (those inside an article or
    main element alone, if they hold half of all words outside links or more), without its blocks that weigh less than
    nothing and aren't sentences. Empty if no block weighs more than nothing."""
    parser = _Blocks()
    parser.read(page)
    parser._end_block()
    blocks = parser.blocks
    inside = [b for b in blocks if b[3]]
    if 2 * sum(b[0] for b in inside) >= sum(b[0] for b in blocks) > 0:
        blocks = inside
    weights = [plain - LINK_WORD * linked - BLOCK_PRICE for plain, linked, _, _ in blocks]
    first, end = main_run(weights)
    return " ".join(b[2] for b, w in zip(blocks[first:end], weights[first:end]) if w > 0 or (not b[1] and b[2][-1] in ".!?:;\"'”’»"))


def page_bodies(pages: DataFrame, key: str, html: str, most_chars: int = PAGE_CHARS) -> DataFrame:
    """(key, body): the main text of each page, up to 4,000 characters, by its blocks (main_text), or where they have none
    by the paragraph rules (body_of); null for a wall, for nothing and for a null page. Of longer pages than `most_chars`
    that many characters are read; a page is a value of one row, and rows that repeat a key keep their own."""
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page[:most_chars]) if page else None for page in batch.column("html").to_pylist()]
            rest = [None if text else page for text, page in zip(found, batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string()), pa.array(rest, pa.string())], ["key", "found", "rest"])

    read = map_arrow(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), work, f"key {kind}, found string, rest string")
    return read.select(F.col("key").alias(key), F.coalesce(_shortened(F.col("found")), body_of(F.col("rest"))).alias("body"))


def _shortened(text: Column) -> Column:
    return F.nullif(F.substring(F.when(~is_paywall(text), text), 1, BODY_CHARS), F.lit(""))

"""HTML blocks and list items: implied end tags, nested chrome, long pages; whole tables against another parser."""

import html as entities
import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import html as H
from tidemark.sources.portal import portal_events, portal_items, portal_topics

PROSE = "A long sentence of the story, told in full and with care. "


def shape(page):
    class Shape(H.Elements):
        def __init__(self):
            super().__init__()
            self.out = []

        def opened(self, tag, attrs):
            self.out.append("<" + tag)

        def closed(self, tag):
            self.out.append(">" + tag)

        def text(self, data):
            self.out.append(data)

    s = Shape()
    s.read(page)
    return " ".join(s.out)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<ul><li>a<li>b</ul>c", "<ul <li a >li <li b >li >ul c"),
        ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", "<ul <li a <ul <li b >li <li c >li >ul d >li <li e >li >ul"),
        ("<ul><li>a<ul></li><li>b</ul></ul>", "<ul <li a <ul <li b >li >ul >li >ul"),
        ("<p>a<p>b<div>c</p>d</div>", "<p a >p <p b >p <div c d >div"),
        ("<p>a<b>c<p>d</b>", "<p a <b c >b >p <p d >p"),
        ("<table><tr><td>a<td><p>b<tr><td>c</table>d", "<table <tr <td a >td <td <p b >p >td >tr <tr <td c >td >tr >table d"),
        ("<dl><dt>a<dd>b<dt>c</dl><br>e</x>f", "<dl <dt a >dt <dd b >dd <dt c >dt >dl <br >br e f"),
        ("<p>a<table><tr><td><p>b</table>", "<p a >p <table <tr <td <p b >p >td >tr >table"),
        ("<div><li>a</div>b</li>", "<div <li a >li >div b"),
    ],
)
def test_implied_end_tags(page, expected):
    assert shape(page) == expected


def test_main_text():
    nested = "<div class='sidebar'><div><div><p>" + PROSE * 9 + "</p></div></div><p>" + PROSE * 9 + "</p></div>"
    assert H.main_text(nested + "<div><p>" + PROSE * 3 + "<p>Short, but a sentence of eight words anyway.</div><footer><p>" + PROSE * 20 + "</footer>") == PROSE * 3 + "Short, but a sentence of eight words anyway."
    linked = "<ul>" + "".join(f"<li><a href=x>{PROSE}</a>" for _ in range(9)) + "</ul>"
    assert H.main_text(linked + "<p>" + PROSE + linked) == PROSE.strip()
    far = "<p>" + PROSE + "</p>" + "<p>Menu</p>" * 9 + "<p>" + PROSE * 4 + "</p>"
    assert H.main_text(far) == (PROSE * 4).strip()
    near = "<p>" + PROSE * 2 + "</p><p>Menu</p><h2>Then it said this.</h2><p>" + PROSE * 4 + "</p>"
    assert H.main_text(near) == PROSE * 2 + "Then it said this. " + (PROSE * 4).strip()
    article = "<p>" + PROSE * 3 + "<article><header><p>" + PROSE + "</p></header><p>" + PROSE * 6 + "</article><p>" + PROSE * 3
    assert H.main_text(article) == (PROSE * 7).strip()
    assert H.main_text("") == H.main_text("<p>Menu<script>" + PROSE * 9 + "</script>") == ""


def test_bodies(spark):
    filler = "<script>" + "x" * 250_000 + "</script>"
    pages = [filler + "<p>" + PROSE * 2, "<p>Subscribe to read the rest of this story today, and much more of it.</p>", "", None, "<p>Short text here.</p>", "<p>" + "Word after word and on. " * 400]
    rows = spark.createDataFrame([(1, p) for p in pages], "page_id int, html string").withColumns({"key": F.lit("k"), "found": F.lit("f")})
    got = [r.body for r in H.page_bodies(rows.repartition(1), "page_id", "html").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(PROSE * 2).strip(), None, None, None, "Short text here.", ("Word after word and on. " * 400)[:4_000]]))
    assert H.page_bodies(rows.limit(0), "page_id", "html").count() == 0


def plain_blocks(page):
    """Blocks by a scan for tags and a recursive walk over the pieces, for pages whose comments and scripts are closed."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", page)
    page = re.sub(r"(?is)<!doctype[^>]*>", "", page)
    pieces = [p for p in re.split(r"""(?s)(<(?:[^>"']|"[^"]*"|'[^']*')*>)""", page) if p]
    blocks, stack, text, links = [], [], [], []

    def end():
        words = " ".join("".join(text).split())
        if words:
            linked = len("".join(links).split())
            blocks.append([len(words.split()) - linked, linked, words, state[0]])
        text.clear(), links.clear()
        state[0] = any(t in ("article", "main") for t, _ in stack)

    state = [False]

    def pop():
        if stack[-1][0] in H.BLOCKS:
            end()
        stack.pop()
        state[0] = state[0] if stack and any(t in ("article", "main") for t, _ in stack) else False

    for piece in pieces:
        close = re.fullmatch(r"(?s)</([a-zA-Z][\w-]*)[^>]*>", piece)
        start = re.fullmatch(r"(?s)<([a-zA-Z][\w-]*)(.*?)/?>", piece)
        if close:
            tag = close[1].lower()
            names = [t for t, _ in stack]
            if tag in names and not (tag in ("li", "p") and any(t in {"li": {"ul", "ol"}, "p": {"td", "th"}}[tag] for t in names[len(names) - names[::-1].index(tag) :])):
                at = len(names) - 1 - names[::-1].index(tag)
                while len(stack) > at:
                    pop()
        elif start:
            tag = start[1].lower()
            names = [t for t, _ in stack]
            if tag == "li":
                scope = max([k for k, t in enumerate(names) if t in ("ul", "ol", "td", "th", "table")], default=-1)
                while "li" in [t for t, _ in stack[scope + 1 :]]:
                    pop()
            names = [t for t, _ in stack]
            if tag in H.BLOCKS and tag not in ("td", "tr", "th", "tbody"):
                scope = max([k for k, t in enumerate(names) if t in ("td", "th")], default=-1)
                while "p" in [t for t, _ in stack[scope + 1 :]]:
                    pop()
            if tag in ("td", "th", "tr"):
                scope = max([k for k, t in enumerate(names) if t in (("tr", "table") if tag != "tr" else ("table",))], default=-1)
                while any(t in ("td", "th", "tr") for t, _ in stack[scope + 1 :]):
                    pop()
            if tag in H.BLOCKS:
                end()
            if tag == "br":
                text.append(" ") if not any(h for _, h in stack) else None
            if tag not in H.VOID:
                named = tag not in ("html", "body", "article", "main") and any(H._CHROME_NAMED.search(entities.unescape(v[1] or v[2])) for v in re.findall(r"""(?i)\b(?:class|id)\s*=\s*("([^"]*)"|'([^']*)')""", start[2]))
                in_article = any(t in ("article", "main") for t, _ in stack)
                stack.append((tag, tag in H.UNSEEN or (tag in H.CHROME and not (tag == "header" and in_article)) or named))
                state[0] = state[0] or any(t in ("article", "main") for t, _ in stack)
        elif not any(h for _, h in stack):
            data = entities.unescape(piece)
            text.append(data)
            if any(t == "a" for t, _ in stack):
                links.append(data + " ")
    while stack:
        pop()
    end()
    return blocks


def test_every_page_by_another_parser(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    assert len(pages) >= 50
    for page in pages:
        mine = H._Blocks()
        mine.read(page)
        mine._end_block()
        assert [b[2] for b in mine.blocks] == [b[2] for b in plain_blocks(page)]
        assert [b[:2] for b in mine.blocks] == [tuple(b[:2]) for b in plain_blocks(page)]
    # The best run of every page, by trying all.
    for page in pages[:60]:
        weights = [plain - H.LINK_WORD * linked - H.BLOCK_PRICE for plain, linked, *_ in plain_blocks(page)]
        first, end = H.main_run(weights)
        assert sum(weights[first:end]) == max([0, *[sum(weights[i:j]) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)]])


def test_unclosed_list_items(spark):
    page = """<div class="current-events-main" id="d1"><p><b>Armed conflicts</b><ul><li>Some war<ul><li>First thing that happened in the war. <a class="external" href="http://a.example">(A)</a>
    <li>Second thing that happened in the war. <a class="external" href="http://b.example">(B)</a></ul><li>Third thing, of no topic at all, happened. <a class="external" href="http://c.example">(C)</a></ul></div>"""
    items = portal_items(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "page_id", "html")
    events = {r.text: (r.topics, r.cites, r.heading) for r in portal_events(items).collect()}
    assert {t.split(" ")[0]: v for t, v in events.items()} == {
        "First": (["Some war"], ["http://a.example"], "Armed conflicts"), "Second": (["Some war"], ["http://b.example"], "Armed conflicts"), "Third": ([], ["http://c.example"], "Armed conflicts")}
    assert [r.name for r in portal_topics(items, "day").collect()] == ["Some war"]

"""Portal pages are read a piece at a time."""

import pyarrow as pa

from tidemark.sources import portal


def test_items_leave_while_a_page_is_read(monkeypatch):
    """The same items whatever the pieces, across characters, tags, references and a long comment; few at once."""
    leaf = '<li>Caf\u00e9 &amp; bar <a class="external x" href="http://x.example/1">(Reuters)</a>'
    page = f'<div class="current-events-main" id="2024-01-01"><p><b>Sports</b></p><!--{"-x" * 300}--><ul><li>A &lt; war<ul>{leaf * 60}</ul></ul></div>'
    whole = portal._Items()
    whole.read(page)
    assert len(whole.items) == 61
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(portal, "READ_BYTES", size)
        parts = list(portal._read(portal._Items(), pa.scalar(page)))
        assert [i for p in parts for i in p] == whole.items
        assert size > 64 or max(map(len, parts)) <= 20
    assert list(portal._read(portal._Items(), pa.scalar(None, pa.string()))) == [[]]


def test_items_of_one_page_come_in_several_batches(spark):
    """A page of 9,000 items isn't one array of the page: a task gives them in batches."""
    page = '<div class="current-events-main" id="2024-01-01"><p><b>Sports</b></p><ul>' + "".join(f"<li>Item {i}" for i in range(9_000)) + "</ul></div>"
    items = portal.portal_items(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "page_id", "html")
    assert "Generate" not in items._jdf.queryExecution().executedPlan().toString()
    got = items.orderBy("seq").collect()
    assert [(r.page_id, r.seq, r.text) for r in got] == [(1, i, f"Item {i}") for i in range(9_000)]

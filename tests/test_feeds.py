"""Feeds of all kinds, cursors, nested sitemaps, replies of models."""

import calendar
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.sources import feeds as S
from tidemark.sources import rss

LONG = "word " * 40
AT = calendar.timegm((2024, 3, 5, 17, 30, 0))


@pytest.mark.parametrize(
    "text, seconds",
    [("Tue, 05 Mar 2024 12:30:00 EST", AT), ("Tue, 5 Mar 2024 13:30:00 EDT", AT), ("05 Mar 2024 17:30:00 GMT", AT), ("Tue, 05 Mar 2024 19:30:00 +0200", AT), ("2024-03-05T17:30:00Z", AT), ("2024-03-05 17:30", AT), ("2024-03-05T19:30:00+02:00", AT),
     ("Tue, 05 Mar 2024 17:30:00", AT), ("soon", None), ("", None), (None, None), ("2024-13-45", None)],
)
def test_times(text, seconds):
    assert rss.seconds_of(text) == seconds


def test_entries():
    atom = f"""<?xml version="1.0" encoding="iso-8859-1"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/"><title>Feed</title><entry><title type="html">A &amp;amp; B&nbsp;C</title>
      <link rel="enclosure" type="image/png" href="http://e/1"/><link rel="alternate" href="http://l/1"/><id>i1</id><author><name>Ann</name></author><content type="xhtml"><div>In <b>bold</b></div></content><published>2024-03-05T17:30:00Z</published>
      <m:group><m:content url="http://v/1.mp4"/><m:thumbnail url="http://t/1"/></m:group></entry></feed>"""
    (e,) = rss.entries_of(atom)
    assert (e["title"], e["link"], e["feed_id"], e["author"], e["content"], e["published"]) == ("A &amp; B\xa0C", "http://l/1", "i1", "Ann", "In bold", AT)
    assert e["thumbnails"] == [{"url": "http://t/1"}] and e["enclosures"] == [{"type": "image/png", "href": "http://e/1"}] and e["contents"] == [{"url": "http://v/1.mp4", "medium": None}]
    rdf = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel/><item><title>T</title><link>http://l/2</link><description><![CDATA[<p>x</p>]]></description><dc:date>2024-03-05T17:30:00Z</dc:date><dc:creator>Bo</dc:creator></item>
      <item><title>U</title><guid>http://l/3</guid><pubDate>soon</pubDate></item></rdf:RDF>"""
    a, b = rss.entries_of(rdf)
    assert (a["content"], a["published"], a["author"]) == ("<p>x</p>", AT, "Bo") and (b["link"], b["published"], b["content"]) == ("http://l/3", None, None)
    assert rss.entries_of("<rss><channel>") is None and rss.entries_of(None) is None and rss.entries_of("<rss/>") == [] and rss.entries_of("") is None
    assert rss.entries_of("\x01<rss><item><title>a\x02b</title></item></rss>")[0]["title"] == "ab"


def test_reader_and_cursors(spark):
    item = lambda title, date: f"<item><title>{title}</title><link>http://x/{title}</link><description>&lt;b&gt;{LONG}&lt;/b&gt;</description>{date}</item>"
    docs = [("a", "<rss><channel>" + item("new", "<pubDate>Tue, 05 Mar 2024 12:30:00 EST</pubDate>") + item("old", "<pubDate>Tue, 05 Mar 2024 10:00:00 EST</pubDate>") + item("undated", "") + item("", "") + "</channel></rss>"), ("b", "<rss><broken"), ("c", None), ("d", "<rss/>")]
    feeds = spark.createDataFrame(docs, "source string, document string").withColumn("title", F.lit("own")).drop("title")
    now = datetime(2024, 3, 6, tzinfo=timezone.utc)
    got = {r.title: r for r in rss.rss_entries(feeds, "document", F.timestamp_seconds(F.lit(AT - 60)), F.lit(now)).collect()}
    assert set(got) == {"new", "undated"} and got["new"].source == "a" and got["new"].content == LONG.strip()
    assert got["undated"].published_on.astimezone(timezone.utc) == now and got["new"].image is None
    cursors = spark.createDataFrame([("a", AT), ("b", AT), ("e", AT)], "source string, at long").select("source", F.timestamp_seconds("at").alias("last_fetched"))
    after = {r.source: r.s for r in rss.advanced(cursors, feeds, "document", F.lit(now)).select("source", F.unix_timestamp("last_fetched").alias("s")).collect()}
    assert after == {"a": int(now.timestamp()), "b": AT, "c": None, "d": int(now.timestamp()), "e": AT}


def index(*children):
    return "<?xml version='1.0'?><sitemapindex xmlns='s'>" + "".join(f"<sitemap><loc>{u}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</sitemap>" for u, m in children) + "</sitemapindex>"


def test_nested_sitemaps(spark):
    """Three levels, a cycle, an undated child, a stale one, one that isn't stored, and more than an index may have."""
    page = lambda name, day: f"<urlset><url><loc> http://x/{name} </loc><lastmod>{day}</lastmod></url></urlset>"
    stored = {
        "r": index(("a", "2024-03-10"), ("b", None), ("stale", "2024-02-01"), ("gone", "2024-03-10")),
        "a": index(("a1", "2024-03-10"), ("r", "2024-03-10"), ("a", None)),
        "b": index(*[(f"m{k}", f"2024-03-{11 + k}") for k in range(5)], ("a1", "2024-03-10")),
        "a1": page("one", "2024-03-10"), "stale": page("no", "2024-03-10"), **{f"m{k}": page(f"m{k}", "2024-03-10") for k in range(5)},
    }
    frame = spark.createDataFrame(list(stored.items()), "url string, doc string")
    at = lambda d: F.lit(d).cast("timestamp")
    got = {r.url: r.depth for r in S.reached_sitemaps(frame, "doc", spark.createDataFrame([("r",)], "url string"), at("2024-03-10"), at("2024-03-11"), most=4).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "a1": 2, "m0": 2, "m1": 2, "m2": 2}  # of b's six the four nearest
    entries = S.entries_in(frame, "doc", spark.createDataFrame([("r",)], "url string"), at("2024-03-10"), at("2024-03-11"))
    assert {r.url for r in entries.collect()} == {"http://x/one", *[f"http://x/m{k}" for k in range(5)]}
    with pytest.raises(RuntimeError):
        S.reached_sitemaps(spark.createDataFrame([(f"{k}", index((f"{k + 1}", None))) for k in range(6)], "url string, doc string"), "doc", spark.createDataFrame([("0",)], "url string"), at("2024-03-10"), at("2024-03-11"), max_depth=3)


def test_replies(spark):
    replies = ['{"k": 1', "{bad}", '[{"k": 1}, {"k": 2', '```json\n{"k": 3}\n```', '[{"k": 4}, {"other": 1}]', "I can't tell.", "", None, "[]", '{"k": 5} trailing']
    got = [[x.k for x in r.items_] for r in spark.createDataFrame(list(enumerate(replies)), "i int, t string").select("i", P.json_items(F.col("t"), "k bigint").alias("items_")).orderBy("i").collect()]
    assert got[:9] == [[], [], [], [3], [4, None], [], [], [], []] and got[9] == []

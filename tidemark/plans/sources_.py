"""Readers and sinks as queries: feed documents are rendered from the driver's tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import cte, load
from ..registry import query
from ..sources import feeds as S
from ..sources.rss import rss_entries
from ..sources.portal import portal_events, portal_items, portal_topics
from ..sources.sinks import merge_state

EV = cte("events")
#: The text of an HTML fragment, in DuckDB.
STRIPPED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""
FEED_SQL = f"select doc_id, 'http://x.example/' || doc_id::varchar as link, 1704067200 + doc_id * 60 as published_s, case when doc_id % 3 = 2 then 'http://i.example/' || doc_id::varchar || '.jpg' end as image from (select doc_id, {STRIPPED.format('text')} as t from documents) where t <> '' and len(string_split(t, ' ')) + 1 >= 30 and doc_id >= 100"


@query("s03_iteration", "select count(*) as n, sum(n_chars)::bigint as chars from documents")
def _(spark, d):
    return load(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s04_s05_rss", FEED_SQL)
def _(spark, d):
    t = load(spark, d, "documents")
    k = F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = lambda hours, form: F.date_format(F.timestamp_seconds(1704067200 + F.col("doc_id") * 60 - hours * 3600), form)
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rss = part("<?xml version='1.0' encoding='utf-8'?><rss><channel><item><title><![CDATA[Headline]]></title><link>http://x.example/", k, "</link><description>", escaped, "</description><pubDate>", at(5, "EEE, dd MMM yyyy HH:mm:ss"), " EST</pubDate></item></channel></rss>")
    atom = part("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='text'>Headline</title><link rel='self' href='http://y.example'/><link href='http://x.example/", k, "'/><id>tag:", k, "</id><summary type='html'>", escaped, "</summary><updated>", at(0, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</updated></entry></feed>")
    media = part("<rss xmlns:content='http://purl.org/rss/1.0/modules/content/' xmlns:media='http://search.yahoo.com/mrss/'><channel><item><title>Headline</title><media:title>Not this</media:title><link>http://x.example/", k, "</link><description>Short</description><content:encoded>", escaped, "</content:encoded><media:content url='http://i.example/", k, ".jpg'/><pubDate>", at(-2, "dd MMM yyyy HH:mm:ss"), " +0200</pubDate></item></channel></rss>")
    feed = F.when(F.col("doc_id") % 3 == 0, rss).when(F.col("doc_id") % 3 == 1, atom).otherwise(media)
    start = F.timestamp_seconds(F.lit(1704067200 + 99 * 60))
    e = rss_entries(t.select("doc_id", feed.alias("xml")), "xml", start, F.current_timestamp())
    return e.select("doc_id", "link", F.unix_timestamp("published_on").alias("published_s"), "image")


@query("s08_fetch_window", "select c_custkey as id, greatest(coalesce(case when c_custkey % 3 > 0 then 1704067200 + c_custkey * 100 end, 1704067200), 1704067200)::bigint as start_s from customer")
def _(spark, d):
    now = F.timestamp_seconds(F.lit(1704067200 + 86400))
    last = F.when(F.col("c_custkey") % 3 > 0, F.timestamp_seconds(1704067200 + F.col("c_custkey") * 100))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.unix_timestamp(S.fetch_start(last, now)).alias("start_s"))


@query("s09_sitemap_candidates", """select s_suppkey as id, array_to_string(list_concat(case when s_suppkey % 3 = 0 then ['http://o/' || s_suppkey::varchar] else [] end, case when s_suppkey % 2 = 0 then ['http://r/a', 'http://s/sitemap.xml'] else [] end, case when s_suppkey % 2 = 0 then [] else ['http://s/sitemap.xml'] end, ['http://s/sitemap_index.xml', 'http://s/news-sitemap.xml']), ' ') as urls from supplier""")
def _(spark, d):
    i = F.col("s_suppkey")
    robots = F.when(i % 2 == 0, "User-agent: *\nSitemap: http://r/a\nsitemap:  http://s/sitemap.xml \nSitemap:\nsitemap: http://r/a")
    urls = S.sitemap_candidates(F.lit("http://s"), F.when(i % 3 == 0, F.concat(F.lit("http://o/"), i.cast("string"))), robots)
    return load(spark, d, "supplier").select(i.alias("id"), F.array_join(urls, " ").alias("urls"))


@query("s09_merged_entries", """with e as (select user_id % 20 as source, event_id % 97 as url, event_id % 4 as candidate, event_id as rank, value, user_id % 20 % 5 = 0 as once from events), f as (select *, row_number() over (partition by source, url order by candidate, rank) as r, min(candidate) over (partition by source) as first from e)
select source, url, candidate, rank from f where r = 1 and (not once or candidate = first)""")
def _(spark, d):
    e = load(spark, d, "events").select((F.col("user_id") % 20).alias("source"), (F.col("id") % 97).alias("url"), (F.col("id") % 4).alias("candidate"), F.col("id").alias("rank"), (F.col("user_id") % 20 % 5 == 0).alias("once"))
    return S.merged_entries(e, "source", "url", "candidate", "rank", "once").select("source", "url", "candidate", "rank")


@query("s10_s11_sitemaps", "select 'http://x.example/a/' || o_orderkey::varchar as url, epoch(o_orderdate)::bigint as s from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-04-01'")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc>http://x.example/a/"), F.col("o_orderkey").cast("string"), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>"))
    maps = load(spark, d, "orders").groupBy(F.last_day("o_orderdate").alias("lastmod")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    near = S.prune_sitemaps(maps, "lastmod", F.lit("1996-03-15").cast("date"), 5)
    at = lambda x: F.lit(x).cast("timestamp")
    return S.urlset(near, "xml", at("1996-03-01"), at("1996-04-01")).select("url", F.unix_timestamp("published").alias("s"))


@query("s10_nested_sitemaps", "select 'http://x.example/a/' || o_orderkey::varchar as url, epoch(o_orderdate)::bigint as s from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-04-01'")
def _(spark, d):
    """Orders of a month, found over an index of years, their indexes of months and the months' sitemaps; the years list their
    root again."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.last_day("o_orderdate").alias("last"))
    entry = F.concat(F.lit("<url><loc>http://x.example/a/"), F.col("o_orderkey").cast("string"), F.lit("</loc><lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    child = lambda url, day: F.concat(F.lit("<sitemap><loc>"), url, F.lit("</loc><lastmod>"), F.date_format(day, "yyyy-MM-dd"), F.lit("</lastmod></sitemap>"))
    many = lambda c, tag, more="": F.concat(F.lit(f"<{tag}>{more}"), F.array_join(F.array_sort(F.collect_set(c)), ""), F.lit(f"</{tag}>")).alias("xml")
    months = o.groupBy(F.col("m").alias("url")).agg(many(entry, "urlset"))
    years = o.groupBy(F.col("y").alias("url")).agg(many(child(F.col("m"), F.col("last")), "sitemapindex", "<sitemap><loc>root</loc></sitemap>"))
    root = o.groupBy(F.lit("root").alias("url")).agg(many(child(F.col("y"), F.make_date(F.year("last"), F.lit(12), F.lit(31))), "sitemapindex"))
    at = lambda x: F.lit(x).cast("timestamp")
    found = S.entries_in(months.unionByName(years).unionByName(root), "xml", root.select("url"), at("1996-03-01"), at("1996-04-01"))
    return found.select("url", F.unix_timestamp("published").alias("s"))


@query("s13_anchors", r"""with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["''][^"'']*["''][^>]*>.*?</a>')) as a from pages),
t as (select page_id, regexp_extract(a, '(?i)href=["'']([^"'']*)["'']', 1) as href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as x from a)
select distinct page_id, href from t where length(x) >= 8""")
def _(spark, d):
    return S.anchors(load(spark, d, "pages").select("page_id", "html"), least=8).select("page_id", "href")


@query("s14_s15_nearest_noon", EV + ", c as (select user_id, started_at::date as day, id, abs(hour(started_at) * 60 + minute(started_at) - 720) as m, started_at from events_) select user_id, day, arg_min(id, (m, started_at)) as id from c group by 1, 2")
def _(spark, d):
    e = load(spark, d, "events").select("user_id", F.to_date("started_at").alias("day"), "id", "started_at")
    return S.nearest_noon(e, ["user_id", "day"], "started_at").select("user_id", "day", "id")


@query("s18_s20_bodies", r"""select page_id, nullif(coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]+property=["'']og:image["''][^>]+content=["'']([^"'']+)["'']', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as found from pages""")
def _(spark, d):
    html = F.col("html")
    return load(spark, d, "pages").select("page_id", F.coalesce(S.og_image(html), S.first_of(html, r"(?is)<title[^>]*>(.*?)</title>")).alias("found"))


@query("s23_rates", "select c_custkey as id, c_acctbal + 2 as value from customer")
def _(spark, d):
    m = F.create_map(F.lit("9"), F.col("c_acctbal") + 1, F.lit("10"), F.col("c_acctbal") + 2, F.lit("2"), F.col("c_acctbal"))
    return S.latest_observation(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), m.alias("m")), "m").select("id", "value")


@query("s24_quakes", "select event_id::varchar as usgs_id, user_id / 10 as magnitude from events where event_id % 10 <> 0")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    f = F.struct(F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("string")).alias("id"), F.struct((F.col("user_id") / 10).alias("mag"), F.lit(1704067200000).alias("time")).alias("properties"))
    return S.quakes(e.select(F.to_json(F.struct(F.array(f).alias("features"))).alias("j")), "j").select("usgs_id", "magnitude")


@query("s25_first_seen", EV + " select user_id, arg_min(id, (started_at, id)) as id from events_ group by 1")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.min_by("id", F.struct("started_at", "id")).alias("id"))


@query("s26_daily_bars", cte("bars") + """, l as (select symbol, max(d) - 3 as start from bars_ where symbol <> '5-LOW' and d < date '2001-01-01' group by 1)
select b.symbol, b.d, b.close, b.volume from bars_ b left join l using (symbol) where b.volume is not null and (l.start is null or b.d >= l.start)""")
def _(spark, d):
    b = load(spark, d, "bars")
    nan = F.lit(float("nan"))
    raw = b.select("symbol", F.col("d").cast("timestamp").alias("d"), nan.alias("open"), nan.alias("high"), nan.alias("low"), F.when(F.col("volume").isNotNull(), F.col("close")).otherwise(nan).alias("close"), "volume")
    return S.daily_bars(raw, b.where("symbol <> '5-LOW' and d < date '2001-01-01'")).where("open is null").select("symbol", "d", "close", "volume")


@query("s31_r11_merge_state", "select c_custkey as id, case when c_custkey % 3 = 0 then c_name || '!' else c_name end as name, c_custkey % 3 = 0 as is_active from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge_state(c.where("id % 2 = 0").withColumn("is_active", F.lit(True)), c.where("id % 3 = 0").select("id", F.concat("name", F.lit("!")).alias("name")), "id")


SECTIONS = {"conflict": "Armed conflicts and attacks", "economic": "Business and economy", "political": "Politics and elections", "disaster": "Disasters and accidents", "health": "Arts and culture"}


def portal_pages(spark, d):
    """A page per day, of the events: a section per category, a topic per sub-category, a leaf per event; events without a
    place are too short, and one in six has no citation."""
    e = load(spark, d, "events").withColumn("day", F.to_date("started_at").cast("string"))
    text = F.concat(F.lit("Event "), F.col("id").cast("string"), F.when(F.col("location_name").isNotNull(), F.concat(F.lit(" is told from "), "location_name")).otherwise(""))
    cite = F.when(F.col("id") % 6 != 0, F.concat(F.lit(' <a class="external text" href="http://x.example/'), F.col("id").cast("string"), F.lit('">(Reuters)</a>'))).otherwise("")
    joined = lambda key, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c))), lambda x: x[c]), "")
    leaves = e.withColumn("li", F.concat(F.lit("<li>"), text, cite, F.lit("</li>"))).groupBy("day", "category", "sub_category").agg(joined("id", "li").alias("lis"))
    topics = leaves.withColumn("ul", F.concat(F.lit('<li><a href="/t">'), "sub_category", F.lit("</a><ul>"), "lis", F.lit("</ul></li>"))).groupBy("day", "category").agg(joined("sub_category", "ul").alias("uls"))
    heading = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v))])[F.col("category")]
    parts = topics.withColumn("part", F.concat(F.lit("<p><b>"), heading, F.lit("</b></p><ul>"), "uls", F.lit("</ul>"))).groupBy("day").agg(joined("category", "part").alias("parts"))
    return parts.select(F.to_date("day").alias("day"), F.concat(F.lit('<div class="current-events-main" id="'), "day", F.lit('"><div class="current-events-content"><p><b>Contents</b></p>'), "parts", F.lit("</div></div>")).alias("html"))


MAPPED = "case category when 'health' then 'general' else category end"


@query("s16_portal_events", EV + f" select started_at::date::varchar as day, id, {MAPPED} as category, sub_category as topic, 'Event ' || id::varchar || ' is told from ' || location_name as text from events_ where location_name is not null and id % 6 <> 0")
def _(spark, d):
    e = portal_events(portal_items(portal_pages(spark, d).withColumnRenamed("day", "page"), "page", "html"))
    return e.select("day", F.substring_index(F.get("cites", F.lit(0)), "/", -1).cast("long").alias("id"), "category", F.get("topics", F.lit(0)).alias("topic"), "text")


@query("s17_portal_topics", EV + f""", t as (select sub_category, started_at::date as day, max(category) as c from events_ group by 1, 2), l as (select sub_category, max(day) as day, arg_max(c, day) as category from t group by 1) select sub_category as slug, sub_category as name, {MAPPED} as category, day from l""")
def _(spark, d):
    items = portal_items(portal_pages(spark, d).withColumnRenamed("day", "page"), "page", "html")
    return portal_topics(items, "page").select("slug", "name", "category", F.col("page").alias("day"))

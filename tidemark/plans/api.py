"""The read interface: each read is a function of tables and parameters that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import evidence as E
from ..functions import places as PL
from ..functions.text import title_of_slug
from ..operators.vectors import communities
from ..registry import query
from .filters import active_on, alive, capped, tri_state

EV, AR, BA, FC = cte("events"), cte("articles"), cte("bars"), cte("forecasts")


def event_detail(events: DataFrame, articles: DataFrame, event_id) -> DataFrame:
    """One event with its articles, newest first."""
    ids = events.where(F.col("id") == event_id).select(F.explode("article_ids").alias("_i")).select(F.expr("try_cast(_i as bigint)").alias("id"))
    return articles.join(ids.where("id is not null").distinct(), "id", "left_semi").orderBy(F.desc("published_s"), F.desc("id"))


def latest_prices(ticks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The newest tick of every active symbol."""
    return ticks.join(symbols.where("is_active").select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(F.max_by("value", "occurred_at").alias("value"), F.max("occurred_at").alias("occurred_at"))


def price_range(ticks: DataFrame, symbol: str, start, end, limit=None) -> DataFrame:
    return ticks.where((F.col("symbol") == symbol) & (F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") <= F.lit(end))).orderBy(F.desc("occurred_at")).limit(capped(limit, 500, 5_000))


def bars(all_bars: DataFrame, symbol: str, limit=None) -> DataFrame:
    """The newest n bars, in ascending order."""
    return all_bars.where(F.col("symbol") == symbol).orderBy(F.desc("d")).limit(capped(limit, 1_000, 5_000)).orderBy("d")


def notices(zones: DataFrame, country: str | None = None, active: str | None = None) -> DataFrame:
    z = tri_state(zones, "is_active", active, "true")
    z = z.where(F.lower("country") == country.lower()) if country else z
    return z.orderBy(F.desc("effective_from"), "id").limit(1_000)


def earthquakes(quakes: DataFrame, now, least: float = 3.0, hours: int = 24, limit=None) -> DataFrame:
    q = quakes.where((F.col("magnitude") >= least) & (F.col("occurred_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")))
    return q.orderBy(F.desc("occurred_at"), "usgs_id").limit(capped(limit, 200, 2_000))


def topics(all_topics: DataFrame, on=None, is_active: str | None = None, source: str | None = None, limit=None) -> DataFrame:
    """Topics active on a day. The source filter comes after the limit, so a page may be short."""
    t = tri_state(all_topics, "is_active", is_active)
    t = active_on(t, on, "started_on", "ended_on") if on else t
    page = t.orderBy("name").limit(capped(limit, 200, 1_000))
    return page.where(F.col("source") == source) if source else page


def topic_events(events: DataFrame, slug: str, limit=None) -> DataFrame:
    return alive(events).where(F.array_contains("topic_slugs", slug)).orderBy(F.desc("started_at"), F.desc("id")).limit(capped(limit, 100, 500))


def header_topics(scored: DataFrame) -> DataFrame:
    """Pinned ones first, then by score or else by count; eight."""
    return scored.orderBy(F.desc("is_pinned"), F.desc(F.coalesce("score", F.col("n").cast("double"))), "slug").limit(8)


def historical_articles(articles: DataFrame, year: int, month: int | None = None, day: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """Articles of a year, month or day, oldest first; the window is half open."""
    first = f"{year:04d}-{month or 1:02d}-{day or 1:02d}"
    step = "1 day" if day else "1 month" if month else "1 year"
    start = F.lit(first).cast("timestamp")
    a = articles.where((F.col("published_on") >= start) & (F.col("published_on") < start + F.expr(f"interval {step}")))
    return (a.where(F.col("source_code").isin(sources)) if sources else a).orderBy("published_on", "id")


def newsletters(issues: DataFrame, limit=None) -> DataFrame:
    """A page of issues, each with the number of all issues."""
    n = max(1, capped(limit, 30, 500))
    total = issues.agg(F.count("*").alias("count"))
    return issues.orderBy(F.desc("day")).limit(n).crossJoin(F.broadcast(total))  # one row


def subscriber_state(subscribers: DataFrame) -> DataFrame:
    """pending until confirmed, active until they leave, then unsubscribed; a later confirmation makes active again."""
    left, joined = F.col("unsubscribed_at"), F.col("confirmed_at")
    return subscribers.withColumn("state", F.when(joined.isNull(), "pending").when(left.isNotNull() & (left >= joined), "unsubscribed").otherwise("active"))


@query("api_latest_prices", BA + " select symbol, arg_max(close, d) as value, max(d) as occurred_at from bars_ where symbol <> '5-LOW' group by 1")
def _(spark, d):
    b = load(spark, d, "bars").select("symbol", F.col("close").alias("value"), F.col("d").alias("occurred_at"))
    return latest_prices(b, b.select("symbol", (F.col("symbol") != "5-LOW").alias("is_active")).distinct())


@query("api_bars", BA + " select * from (select d, close from bars_ where symbol = '2-HIGH' order by d desc limit 50) order by d")
def _(spark, d):
    return bars(load(spark, d, "bars"), "2-HIGH", "50").select("d", "close")


@query("api_topics", "select id from (select p_partkey as id, p_brand as source from part where (p_size % 4 = 0 or p_size <= 20) and (p_size % 5 = 0 or p_size + 10 >= 20) order by p_name, p_partkey limit 1000) where source = 'Brand#11'")
def _(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.format_string("%09d", "p_partkey")).alias("name"), F.col("p_brand").alias("source"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("started_on"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 10).alias("ended_on"), F.lit(True).alias("is_active"))
    return topics(p, on=20, source="Brand#11", limit=5_000).select("id")


@query("api_topic_events", EV + " select id from events_ where is_deleted is distinct from true and list_contains(string_split(topics, ','), 'fed-rates') order by started_at desc, id desc limit 100")
def _(spark, d):
    return topic_events(load(spark, d, "events").withColumn("topic_slugs", F.split("topics", ",")), "fed-rates").select("id")


@query("api_historical_articles", "select o_orderkey as id from orders where o_orderdate >= timestamp '1997-02-01' and o_orderdate < timestamp '1997-03-01' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_on"), F.col("o_orderpriority").alias("source_code"))
    return historical_articles(o, 1997, 2, sources=["1-URGENT", "2-HIGH"]).select("id")


@query("api_earthquakes", "select event_id as id from events where user_id / 10 >= 3.0 and ts >= timestamp '2024-01-29' order by ts desc, event_id::varchar limit 200")
def _(spark, d):
    q = load(spark, d, "events").select("id", F.col("id").cast("string").alias("usgs_id"), (F.col("user_id") / 10).alias("magnitude"), F.col("started_at").alias("occurred_at"))
    return earthquakes(q, "2024-01-30").select("id")


@query("api_newsletters", "select o_orderdate::date as day, (select count(distinct o_orderdate::date) from orders) as count from orders group by 1 order by 1 desc limit 30")
def _(spark, d):
    return newsletters(load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct())


GATE_TEXT = ["troops attack the town", "an earthquake and a flood", "the pope meets an envoy about the war", "a quiet festival", "blast at a factory", "patients fill the hospital", "drone strikes a refinery, fire", "crowds protest a law", "", "shot dead near the border", "the clinic closes"]
_LIST = "[" + ", ".join(f"'{t}'" for t in GATE_TEXT) + "]"


def _re(p: str) -> str:
    return f"regexp_matches(x, '(?i){p}')"


@query("c22_c23_evidence_gates", AR + f""", t as (select id, category as c, coalesce(sub, 'x') as sub, coalesce(content, '') || ' ' || {_LIST}[1 + (id % 11)::int] as x from (select *, ['protest-policy', 'other', 'war'][1 + (id % 3)::int] as sub from articles_)),
s as (select *, case when c = 'conflict' and not ({_re(E.MILITARY)} or {_re(E.ACTOR)}) and ({_re(E.NATURAL)} or {_re(E.ACCIDENT)}) then 'disaster' when c = 'disaster' and {_re(E.MILITARY)} and {_re(E.CONFLICT)} then 'conflict'
 when c = 'conflict' and not ({_re(E.MILITARY)} or {_re(E.ACTOR)}) and {_re(E.MEETING)} then 'political' else c end as s from t)
select id, case when c = 'political' and sub = 'protest-policy' and not {_re(E.PROTEST)} then 'other' else sub end as sub, case when s = 'conflict' and not {_re(E.CONFLICT)} then 'general' when s = 'disaster' and not ({_re(E.NATURAL)} or {_re(E.ACCIDENT)}) then 'general' when s = 'health' and not {_re(E.HEALTH)} then 'economic' else s end as gated from s""")
def _(spark, d):
    more = F.element_at(F.array(*map(F.lit, GATE_TEXT)), (F.col("id") % len(GATE_TEXT) + 1).cast("int"))
    e = load(spark, d, "articles").withColumn("x", F.concat(F.coalesce("content", F.lit("")), F.lit(" "), more)).withColumn("sub", F.element_at(F.array(F.lit("protest-policy"), F.lit("other"), F.lit("war")), (F.col("id") % 3 + 1).cast("int")))
    gated = E.guarded(E.gated(F.col("category"), F.col("x")), F.col("x"), F.lit("economic"))
    return e.select("id", E.sub_guarded(F.col("category"), F.col("sub"), F.col("x")).alias("sub"), gated.alias("gated"))


COUNTRIES = ["Ukraine", "Russia", "Iran", "Peru", "Germany", "United Arab Emirates", "Georgia"]
PLACE_TEXT = ["Fighting in the Gaza Strip and Russia", "Chinese authorities detain two", "nothing to see", "Biden wins Georgia recount in US", "the UAE and Iran sign", "Peruvian farmers and Kosovo"]
DEMONYM = r"(?i)\b(" + "|".join(sorted(PL.DEMONYMS, key=lambda n: (-len(n), n))) + r")\b"


@query("c17_c18_c21_find_place", AR + f""", t as (select id, {PLACE_TEXT}[1 + (id % 6)::int] || '. ' || coalesce(content, '') as x from articles_), f as (select id, x, nullif(regexp_extract(x, '{PL.place_pattern(COUNTRIES)}', 1), '') as p, lower(regexp_extract(x, '{DEMONYM}', 1)) as w from t),
c as (select id, x, coalesce(p, case w {" ".join(f"when '{k}' then '{v}'" for k, v in PL.DEMONYMS.items())} end) as place from f)
select id, case when lower(place) = 'georgia' and regexp_matches(x, '{PL.US_CONTEXT}') then 'United States' else place end as place from c""")
def _(spark, d):
    x = F.concat(F.element_at(F.array(*map(F.lit, PLACE_TEXT)), (F.col("id") % 6 + 1).cast("int")), F.lit(". "), F.coalesce("content", F.lit("")))
    a = load(spark, d, "articles").select("id", x.alias("x"))
    return a.select("id", PL.state_or_country(PL.find_place(F.col("x"), COUNTRIES), F.col("x")).alias("place"))


@query("c20_city_conflicts", "select c_custkey as id, c_custkey % 3 = 1 as conflict from customer")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("Kiev").alias("city"), F.when(F.col("c_custkey") % 3 == 0, "Ukraine").when(F.col("c_custkey") % 3 == 1, "Russian Federation").otherwise("Atlantis").alias("country"))
    cities = spark.createDataFrame([("Kyiv", "Ukraine")], "city string, city_country string")
    return PL.city_conflicts(c, cities, COUNTRIES).select("id", "conflict")


@query("c24_verdict", EV + " select id, case when category <> 'health' then category end as category, greatest(0, least(1, coalesce(sentiment * 2, 0)))::double as confidence, case when sub_category = 'war' then 'other' else sub_category end as sub from events_")
def _(spark, d):
    v = E.verdict(F.col("category"), F.col("sentiment") * 2, F.when(F.col("sub_category") == "war", " ").otherwise(F.col("sub_category")), ["economic", "conflict", "political", "disaster"])
    return load(spark, d, "events").select("id", v.alias("v")).select("id", "v.*")


@query("f29_anachronism", EV + " select id, not (started_at < timestamp '2024-01-15' and id % 3 = 0) as may_match from events_")
def _(spark, d):
    begun = F.when(F.col("id") % 3 == 0, F.to_timestamp(F.lit("2024-01-15")))
    return load(spark, d, "events").select("id", (~F.coalesce(begun > F.col("started_at"), F.lit(False))).alias("may_match"))


@query("s12_title_of_slug", r"""with p as (select page_id, string_split(trim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '/')[-1] as last from pages)
select page_id, coalesce(array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(last, '\.[a-z]{2,5}$', ''), '[-_]+', ' ', 'g')), '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || lower(w[2:])), ''), '') as title from p""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", title_of_slug(F.col("url")).alias("title"))


@query("u05_communities", """with t as (select vec_id as id, label as g, embedding::double[] as v from embeddings where label is not null), l as materialized (select a.id as a, b.id as b from t a join t b on a.g = b.g where list_cosine_similarity(a.v, b.v) >= 0.55),
n as (select a, count(*) as n from l group by a), c as (select l.a, arg_min(l.b, (-n.n, l.b)) as c from l join n on n.a = l.b group by l.a) select t.id, t.g as bucket, coalesce(c.c, t.id) as community from t left join c on c.a = t.id""")
def _(spark, d):
    t = load(spark, d, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))
    return communities(t).join(t.select("id", "bucket"), "id").select("id", "bucket", "community")

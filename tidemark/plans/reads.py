"""Further read interfaces: one event, prices of a symbol, notices and their history, subscribers, header topics, countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import parsing as P
from ..registry import query
from .api import bars, event_detail, header_topics, notices, price_range, subscriber_state
from .filters import capped, list_events

EV, AR, BA = cte("events"), cte("articles"), cte("bars")


def notice_history(records: DataFrame, start=None, end=None, country: str | None = None, status: str | None = None, limit=None) -> DataFrame:
    """Notices that began in [start, end], of a country (any case) and a status, the newest first: 200, or up to 2,000."""
    r = records.where(F.lower("country") == country.lower()) if country else records
    r = r.where(F.col("status") == status) if status else r
    r = r.where(F.col("effective_from") >= F.lit(start).cast("timestamp")) if start else r
    r = r.where(F.col("effective_from") <= F.lit(end).cast("timestamp")) if end else r
    return r.orderBy(F.desc("effective_from"), "id").limit(capped(limit, 200, 2_000))


def country_index(cities: DataFrame, countries: DataFrame) -> DataFrame:
    """(country, latitude, longitude): lower-case names of countries (code, name, capital) with the place of their capital, the
    largest of all cities (name, code, population, latitude, longitude) of that name, or else of their own largest city. Of
    equally large cities that of the least id (column id) counts; countries without either are left out."""
    place = F.struct("latitude", "longitude")
    largest = F.max_by(place, F.struct(F.coalesce("population", F.lit(0)), -F.col("id")))
    by_name = cities.groupBy(F.lower("name").alias("city")).agg(largest.alias("own"))
    by_code = cities.where("code is not null and code <> ''").groupBy("code").agg(largest.alias("other"))
    c = countries.select("code", F.lower("name").alias("country"), F.lower(F.trim(F.coalesce("capital", F.lit("")))).alias("city"))
    found = c.join(by_name, "city", "left").join(by_code, "code", "left").withColumn("place", F.coalesce("own", "other"))
    return found.where("place is not null").select("country", "place.latitude", "place.longitude")


@query("api_event_by_id", AR + " select id, title from articles_ where id in (17, 18, 3) order by published_s desc, id desc")
def _(spark, d):
    e = load(spark, d, "events").withColumn("article_ids", F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"), F.lit("3"), F.lit("none"), F.lit("3")))
    return event_detail(e, load(spark, d, "articles"), 17).select("id", "title")


@query("api_prices_of_a_symbol", BA + " select d, close from bars_ where symbol = '1-URGENT' and d >= date '1996-01-01' and d <= date '1997-12-31' order by d desc limit 500")
def _(spark, d):
    ticks = load(spark, d, "bars").select("symbol", "close", F.col("d").alias("occurred_at"))
    return price_range(ticks, "1-URGENT", "1996-01-01", "1997-12-31").select(F.col("occurred_at").alias("d"), "close")


@query("api_bars_by_default", BA + " select * from (select d, close from bars_ where symbol = '3-MEDIUM' order by d desc limit 1000) order by d")
def _(spark, d):
    return bars(load(spark, d, "bars"), "3-MEDIUM").select("d", "close")


def _zones(spark, d):
    o = F.col("o_orderkey")
    return load(spark, d, "orders").select(o.alias("id"), F.when(o % 3 == 0, "UA").when(o % 3 == 1, "ru").alias("country"), (o % 4 == 0).alias("is_active"), F.col("o_orderdate").cast("timestamp").alias("effective_from"), F.col("o_orderstatus").alias("status"))


@query("api_notices", "select o_orderkey as id from orders where o_orderkey % 4 = 0 and o_orderkey % 3 = 1 order by o_orderdate desc, o_orderkey limit 1000")
def _(spark, d):
    return notices(_zones(spark, d), "RU").select("id")


@query("api_notice_history", "select o_orderkey as id from orders where o_orderkey % 3 = 0 and o_orderstatus = 'F' and o_orderdate >= timestamp '1995-06-01' and o_orderdate <= timestamp '1996-06-01' order by o_orderdate desc, o_orderkey limit 2000")
def _(spark, d):
    return notice_history(_zones(spark, d), "1995-06-01", "1996-06-01", "ua", "F", "9999").select("id")


@query("api_subscribers", """with s as (select c_custkey as id, case when c_custkey % 3 > 0 then c_custkey * 10 end as joined, case when c_custkey % 4 = 0 then c_custkey * 9 when c_custkey % 4 = 1 then c_custkey * 11 when c_custkey % 4 = 2 then c_custkey * 10 end as gone from customer)
select id, case when joined is null then 'pending' when gone >= joined then 'unsubscribed' else 'active' end as state from s""")
def _(spark, d):
    k = F.col("c_custkey")
    s = load(spark, d, "customer").select(k.alias("id"), F.when(k % 3 > 0, k * 10).alias("confirmed_at"), F.when(k % 4 == 0, k * 9).when(k % 4 == 1, k * 11).when(k % 4 == 2, k * 10).alias("unsubscribed_at"))
    return subscriber_state(s).select("id", "state")


@query("t07_header_topics", "select p_partkey as id from part order by p_size = 50 desc, case when p_partkey % 2 = 0 then p_retailprice else p_size::double end desc, p_partkey limit 8")
def _(spark, d):
    k = F.col("p_partkey")
    t = load(spark, d, "part").select(k.alias("id"), F.lpad(k.cast("string"), 9, "0").alias("slug"), (F.col("p_size") == 50).alias("is_pinned"), F.when(k % 2 == 0, F.col("p_retailprice").cast("double")).alias("score"), F.col("p_size").alias("n"))
    return header_topics(t).select("id")


@query("f10_affected_symbol", EV + " select id from events_ where is_deleted is distinct from true and (list_contains(string_split(topics, ','), 'inflation') and id % 2 = 0 or id % 5 = 0) order by started_at desc, id desc limit 500")
def _(spark, d):
    i = F.col("id")
    named = F.transform(F.filter(F.split("topics", ","), lambda t: (t == "inflation") & (i % 2 == 0)), lambda t: F.struct(F.lit("GC=F").alias("symbol"), F.lit(0.5).alias("weight")))
    other = F.when(i % 5 == 0, F.array(F.struct(F.lit("GC=F").alias("symbol"), F.lit(-0.5).alias("weight")))).otherwise(F.array(F.struct(F.lit("SPY").alias("symbol"), F.lit(0.1).alias("weight"))))
    e = load(spark, d, "events").withColumn("affected", F.concat(named, other))
    return list_events(e, symbol="GC=F", limit=500).select("id")


@query("c20_country_index", """with city as (select s_suppkey as id, case when s_suppkey % 4 = 0 then 'Ursa' else s_name end as name, (s_nationkey + s_suppkey) % 30 as code, s_acctbal as population, s_suppkey % 90 + 0.5 as lat, s_suppkey % 180 - 0.25 as lon from supplier),
nat as (select n_nationkey as code, lower(n_name) as country, case when n_nationkey % 5 = 0 then 'ursa' when n_nationkey % 5 = 1 then (select lower(min(s_name)) from supplier) when n_nationkey % 5 = 2 then 'nowhere' end as capital from nation),
n as (select lower(name) as name, arg_max((lat, lon), (population, -id)) as p from city group by 1), c as (select code, arg_max((lat, lon), (population, -id)) as p from city group by 1)
select country, coalesce(n.p, c.p)[1] as latitude, coalesce(n.p, c.p)[2] as longitude from nat left join n on n.name = nat.capital left join c on c.code = nat.code where coalesce(n.p, c.p) is not null""")
def _(spark, d):
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    cities = s.select(k.alias("id"), F.when(k % 4 == 0, "Ursa").otherwise(F.col("s_name")).alias("name"), ((F.col("s_nationkey") + k) % 30).cast("string").alias("code"), F.col("s_acctbal").alias("population"), (k % 90 + F.lit(0.5)).alias("latitude"), (k % 180 - F.lit(0.25)).alias("longitude"))
    n = F.col("n_nationkey")
    first = F.broadcast(s.agg(F.min("s_name").alias("first")))  # one row
    countries = load(spark, d, "nation").crossJoin(first).select(n.cast("string").alias("code"), F.col("n_name").alias("name"), F.when(n % 5 == 0, " Ursa ").when(n % 5 == 1, F.col("first")).when(n % 5 == 2, "Nowhere").alias("capital"))
    return country_index(cities, countries)


@query("c35_rings", """with q as (select s_suppkey as id, (s_suppkey % 80 + 0.5)::double as lat, (s_suppkey % 170 - 0.25)::double as lon, (1 + s_suppkey % 40)::double as r from supplier), p as (select *, unnest(range(33)) as i from q)
select id, i, round(lon + r / 60 * cos(i * (2 * 3.141592653589793 / 32)) / cos(radians(lat)), 6) as x, round(lat + r / 60 * sin(i * (2 * 3.141592653589793 / 32)), 6) as y from p""")
def _(spark, d):
    k = F.col("s_suppkey")
    q = load(spark, d, "supplier").select(k.alias("id"), P.circle((k % 80 + F.lit(0.5)).cast("double"), (k % 170 - F.lit(0.25)).cast("double"), (1 + k % 40).cast("double")).alias("ring"))
    return q.select("id", F.posexplode("ring").alias("i", "p")).select("id", F.col("i").cast("long").alias("i"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))

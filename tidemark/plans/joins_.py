"""Joins: lookups, one-to-many, semi and anti, as-of, interval, token overlap, cosine, rules, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import routing as R
from ..functions import text as T
from ..functions.numbers import places
from ..operators.joins import as_of, insert_new, interval_join, near_labels, overlap_pairs, upsert
from ..operators.tables import written
from ..operators.vectors import best_matches
from ..registry import query

EV, AR, BA, HO = cte("events"), cte("articles"), cte("bars"), cte("hours")
DAY = 86400


@query("j01_source_names", cte("articles", "sources") + " select a.id, coalesce(s.name, a.source_code) as source_name from articles_ a left join sources_ s on s.code = a.source_code")
def _(spark, d):
    return load(spark, d, "articles").join(load(spark, d, "sources"), F.col("source_code") == F.col("code"), "left").select("id", F.coalesce("name", "source_code").alias("source_name"))


@query("j02_event_articles", AR + """, e as (select cluster, list(id::varchar) as ids from articles_ where city = 'Kyiv' group by 1), x as (select cluster, unnest(list_append(ids, 'not-an-id')) as i from e)
select x.cluster, a.id, a.title from x join articles_ a on a.id = try_cast(x.i as bigint)""")
def _(spark, d):
    a = load(spark, d, "articles")
    e = a.where("city = 'Kyiv'").groupBy("cluster").agg(F.array_append(F.collect_list(F.col("id").cast("string")), "not-an-id").alias("ids"))
    x = e.select("cluster", F.explode("ids").alias("i")).select("cluster", F.expr("try_cast(i as bigint)").alias("id")).where("id is not null")
    return x.join(a.select("id", "title"), "id")


@query("j03_j04_semi_and_anti", "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as had_finished from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = load(spark, d, "orders")
    c = load(spark, d, "customer").join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(f, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("had_finished"))


@query("j05_d03_upsert", EV + """, n as (select category, started_at::date as day, arg_max({'t': sub_category, 'n': article_count, 'c': location_name}, id) as s from events_ where id % 2 = 0 group by 1, 2),
o as (select category, started_at::date as day, arg_max({'t': sub_category, 'n': article_count, 'c': location_name}, id) as s from events_ where id % 3 = 0 and id % 2 = 1 and category <> 'health' group by 1, 2)
select coalesce(o.category, n.category) as category, coalesce(o.day, n.day) as day, case when n.s is not null then n.s.t else o.s.t end as sub_category, case when n.s is not null then n.s.n else o.s.n end as article_count, case when o.s is not null then o.s.c else n.s.c end as location_name from o full join n on o.category = n.category and o.day = n.day""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("day", F.to_date("started_at"))
    values = F.struct("sub_category", "article_count", "location_name")
    current = e.where("id % 3 = 0 and id % 2 = 1 and category <> 'health'").groupBy("category", "day").agg(F.max_by(values, "id").alias("v")).select("category", "day", "v.*")
    incoming = e.where("id % 2 = 0").select("category", "day", "sub_category", "article_count", "location_name", "id")
    return _upsert_events(current, incoming)


def _upsert_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    with_order = current.withColumn("id", F.lit(None).cast("long"))
    return upsert(with_order, incoming, ["category", "day"], F.col("id"), ["location_name"]).drop("id")


@query("j06_as_of_backward", cte("bars") + """, e as (select o_orderkey as id, o_orderpriority as symbol, (o_orderdate + interval 12 hours)::date + (o_orderkey % 3)::int as at from orders)
select e.id, b.d as bar_day, b.close from e asof left join bars_ b on e.symbol = b.symbol and e.at >= b.d""")
def _(spark, d):
    e = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), F.date_add("o_orderdate", (F.col("o_orderkey") % 3).cast("int")).alias("at"))
    b = load(spark, d, "bars").withColumn("bar_day", F.col("d"))
    return as_of(e, b, ["symbol"], "at", "d", ["bar_day", "close"]).select("id", "bar_day", "close")


@query("j07_as_of_forward", cte("hours", "events") + """, b as (select symbol, t, close, lag(t) over (partition by symbol order by t) as prev_t, close / lag(close) over (partition by symbol order by t) - 1 as ret from hours_), e as (select id, category, floor(epoch(started_at))::bigint as s, ['click','error','purchase','signup','view'][1 + (id % 5)::int] as symbol from events_)
select e.id, b.t as next_t, b.ret from e join b on e.symbol = b.symbol and e.s >= b.prev_t and e.s < b.t""")
def _(spark, d):
    by_time = Window.partitionBy("symbol").orderBy("t")
    b = load(spark, d, "hours").select("symbol", F.col("t").alias("next_t"), F.lag("t").over(by_time).alias("prev_t"), (F.col("close") / F.lag("close").over(by_time) - 1).alias("ret"))
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    e = load(spark, d, "events").select("id", F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("symbol"), F.unix_timestamp("started_at").alias("s"))
    # The bar whose predecessor is the last one at or before s: an as-of on the predecessor.
    met = as_of(e, b.where("prev_t is not null"), ["symbol"], "s", "prev_t", ["next_t", "ret"], width=86_400)
    return met.where("s < next_t").select("id", "next_t", "ret")


@query("j08_j11_forward_bounded", BA + """, x as (select symbol, d, close, lead(close, 5) over (partition by symbol order by d) as fifth from bars_)
select x.symbol, x.d, x.fifth, (select arg_min(y.close, y.d) from bars_ y where y.symbol = x.symbol and y.d > x.d and y.d <= x.d + 4) as within_4 from x""")
def _(spark, d):
    by_day = Window.partitionBy("symbol").orderBy("d")
    b = load(spark, d, "bars").withColumn("fifth", F.lead("close", 5).over(by_day)).withColumn("n", F.lead(F.struct("d", "close")).over(by_day))
    return b.select("symbol", "d", "fifth", F.when(F.datediff(F.col("n.d"), "d") <= 4, F.col("n.close")).alias("within_4"))


@query("j09_nearest", cte("bars") + """, e as (select c_custkey as id, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][1 + (c_custkey % 5)::int] as symbol, date '1995-01-01' + (c_custkey * 7 % 2400)::int as at from customer),
p as (select e.*, s.d as pd, s.close as pc from e asof left join bars_ s on e.symbol = s.symbol and e.at >= s.d), n as (select e.id, s.d as nd, s.close as nc from e asof left join bars_ s on e.symbol = s.symbol and e.at <= s.d)
select p.id, case when nd is null or (pd is not null and p.at - pd <= nd - p.at) then pc else nc end as close from p join n using (id)""")
def _(spark, d):
    s = load(spark, d, "bars").select(F.col("symbol").alias("k"), F.datediff("d", F.lit("1995-01-01")).alias("day"), "close")
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    e = load(spark, d, "customer").select(F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("k"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 2400).cast("int").alias("at"))
    back = as_of(e, s.select("k", "day", F.col("day").alias("pd"), F.col("close").alias("pc")), ["k"], "at", "day", ["pd", "pc"])
    mirrored = s.select("k", (-F.col("day")).alias("m"), F.col("day").alias("nd"), F.col("close").alias("nc"))
    both = as_of(back.withColumn("am", -F.col("at")), mirrored, ["k"], "am", "m", ["nd", "nc"])
    earlier = F.col("nd").isNull() | (F.col("pd").isNotNull() & (F.col("at") - F.col("pd") <= F.col("nd") - F.col("at")))
    return both.select("id", F.when(earlier, F.col("pc")).otherwise(F.col("nc")).alias("close"))


@query("j10_interval_join", cte("hours", "events") + """, e as (select id, sub_category, floor(epoch(started_at))::bigint as s from events_ where category = 'conflict')
select h.symbol, h.t, count(*) as n, sum(e.id)::bigint as ids from hours_ h join e on e.s >= h.t - 86400 and e.s <= h.t group by 1, 2""")
def _(spark, d):
    e = load(spark, d, "events").where("category = 'conflict'").select("id", F.unix_timestamp("started_at").alias("s"))
    h = load(spark, d, "hours").select("symbol", "t", (F.col("t") - DAY).alias("lo"))
    return interval_join(e, h.withColumn("hi", F.col("t")), "s", "lo", "hi", DAY).groupBy("symbol", "t").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


TOK = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-zA-Z0-9]+'), lambda w: length(w) > 2 and not list_contains([" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)))"


@query("j12_c14_corroboration", AR + f""", t as (select id, source_code, unnest({TOK.format("title")}) as w, len({TOK.format("title")}) as n from articles_),
p as (select a.id, b.source_code, b.id as other, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.w = b.w and a.source_code <> b.source_code group by 1, 2, 3)
select id, least(0.5 * count(distinct source_code), 2.0)::double as bonus from p where c / (na + nb - c) >= 0.5 group by 1""")
def _(spark, d):
    a = load(spark, d, "articles").select("id", "source_code", T.tokens(F.col("title")).alias("tokens"))
    return corroboration(a)


def corroboration(articles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, bonus): 0.5 for each other source with a title that similar, 2 at most. Equal token sets are one row
    before they meet others, so that a title filed a thousand times meets others once."""
    sets = written(articles.select("id", "source_code", F.sort_array("tokens").alias("key")), "titles")
    kinds = written(sets.where(F.size("key") > 0).groupBy("key").agg(F.min("id").alias("kind"), F.collect_set("source_code").alias("sources")), "kinds")
    # Five sources of what a kind is near to, its own too, tell as much as more.
    near = near_labels(kinds, "kind", "key", "sources", *threshold.as_integer_ratio(), 5)
    mine = sets.join(kinds.select("key", "kind"), "key").join(near, "kind")
    others = F.size("labels") - F.array_contains("labels", F.col("source_code")).cast("int")
    return mine.select("id", F.least(0.5 * others, F.lit(2.0)).alias("bonus")).where("bonus > 0")


@query("j13_c03_topic_keywords", AR + f""", e as (select id, unnest({TOK.format("title")}) as w from articles_), s as (select source_code as topic, arg_min(title, id) || ' ' || source_code as name from articles_ where title is not null group by 1), k as (select topic, unnest({TOK.format("name")}) as w, len({TOK.format("name")}) as n from s)
select id, topic, round_even(least(1.0, 0.3 + count(*) / any_value(n))::double, 3) as score from e join k using (w) group by 1, 2 having count(*) >= 1 and count(*) / any_value(n) >= 0.1""")
def _(spark, d):
    e = load(spark, d, "articles").select("id", T.tokens(F.col("title")).alias("tokens"))
    # A topic per source, named like its first article.
    names = load(spark, d, "articles").where("title is not null").groupBy(F.col("source_code").alias("topic")).agg(F.min_by("title", "id").alias("name"))
    k = names.select("topic", T.tokens(F.concat_ws(" ", "name", "topic")).alias("tokens"))
    p = overlap_pairs(e, k, "id", "topic", "tokens").withColumn("frac", F.col("common") / F.col("n_right"))
    return p.where("common >= 1 and frac >= 0.1").select("id", "topic", places(F.least(F.lit(1.0), 0.3 + F.col("frac")), 3).alias("score"))


def retroactive_tags(events: DataFrame, topics: DataFrame, since) -> DataFrame:
    """Events (id, started_s, tokens, topics as a map, topics_source) after topics (slug, tokens) are looked for in those that
    began at `since` or later: a topic whose tokens an event shares a tenth of is added with its score, unless the event has
    it already; the others stay, and so do their scores. An event that got one has the source `keyword`."""
    wanted = topics.where(F.size("tokens") > 0).select("slug", "tokens")
    pairs = overlap_pairs(events.where(F.col("started_s") >= since), wanted, "id", "slug", "tokens").withColumn("frac", F.col("common") / F.col("n_right")).where("frac >= 0.1")
    scored = pairs.select(F.col("id").alias("_id"), F.struct("slug", places(F.least(F.lit(1.0), 0.3 + F.col("frac")), 3).alias("score")).alias("t")).groupBy("_id").agg(F.map_from_entries(F.array_sort(F.collect_list("t"))).alias("found"))
    new = F.map_filter("found", lambda k, _: ~F.map_contains_key("topics", k))
    merged = events.join(scored, F.col("id") == F.col("_id"), "left").withColumn("new", F.coalesce(new, F.expr("cast(map() as map<string, double>)")))
    return merged.withColumns({"topics": F.map_concat("topics", "new"), "topics_source": F.when(F.size("new") > 0, "keyword").otherwise(F.col("topics_source"))}).drop("_id", "found", "new")


@query("r15_retroactive_tags", AR + f""", e as (select id, unnest({TOK.format("title")}) as w from articles_ where published_s >= 1704187200), s as (select source_code as topic, arg_min(title, id) || ' ' || source_code as name from articles_ where title is not null group by 1), k as (select topic, unnest({TOK.format("name")}) as w, len({TOK.format("name")}) as n from s),
m as (select id, topic, round_even(least(1.0, 0.3 + count(*) / any_value(n))::double, 3) as score from e join k using (w) group by 1, 2 having count(*) / any_value(n) >= 0.1), x as (select m.* from m join articles_ a using (id) where not (id % 2 = 0 and topic = a.source_code)), g as (select id, count(*) as n, sum(score) as total from x group by 1)
select id, case when id % 2 = 0 and source_code is not null then 1 else 0 end + coalesce(n, 0) as n_topics, round(coalesce(total, 0), 6) as added, case when n > 0 then 'keyword' else 'feed' end as topics_source from articles_ left join g using (id)""")
def _(spark, d):
    a = load(spark, d, "articles")
    names = a.where("title is not null").groupBy(F.col("source_code").alias("slug")).agg(F.min_by("title", "id").alias("name"))
    topics = names.where("slug is not null").select("slug", T.tokens(F.concat_ws(" ", "name", "slug")).alias("tokens"))
    own = F.when((F.col("id") % 2 == 0) & F.col("source_code").isNotNull(), F.create_map("source_code", F.lit(0.0))).otherwise(F.expr("cast(map() as map<string, double>)"))
    e = a.select("id", F.col("published_s").alias("started_s"), T.tokens(F.col("title")).alias("tokens"), own.alias("topics"), F.lit("feed").alias("topics_source"))
    out = retroactive_tags(e, topics, 1704187200)
    return out.select("id", F.size("topics").cast("long").alias("n_topics"), F.round(F.aggregate(F.map_values("topics"), F.lit(0.0), lambda s, x: s + x), 6).alias("added"), "topics_source")


@query("j14_j15_prototypes", """with p as (select arg_min(embedding, vec_id)::double[] as proto, label as cat from embeddings where label is not null group by label),
s as (select e.vec_id, p.cat, list_cosine_similarity(e.embedding::double[], p.proto) as s from embeddings e, p) select vec_id, arg_max(cat, (s, -cat)) as best, round(max(s), 6) as score, count(*) filter (where s >= 0.42) as matches from s group by 1""")
def _(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    proto = e.where("label is not null").groupBy(F.col("label").alias("key")).agg(F.min_by("vector", "id").alias("vector"))
    return best_matches(e.select("id", "vector"), proto, 0.42).select(F.col("id").alias("vec_id"), "best", F.round("score", 6).alias("score"), "matches")


@query("j16_gazetteer", "select s.s_suppkey, coalesce(n.n_name, 'unknown') as country, coalesce(r.r_name, 'unknown') as region from supplier s left join nation n on n.n_nationkey = s.s_nationkey + 3 left join region r on r.r_regionkey = n.n_regionkey")
def _(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")  # 25 and 5 rows
    s = load(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") + 3 == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("country"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ROUTE = EV + f""", topic(slug, k, symbol) as (values {_values([(t, i, s) for t, ss in R.TOPIC_SYMBOLS.items() for i, s in enumerate(ss)])}),
rule(cat, region, o, k, symbol) as (values {_values([(c, r, o, i, s) for o, (c, r, ss) in enumerate(R.REGION_RULES) for i, s in enumerate(ss)])}),
affinity(cat, symbol, a) as (values {_values([(c, s, a) for (c, s), a in R.SYMBOL_AFFINITY.items()])}), sub(name, a) as (values {_values(list(R.SUB_CATEGORY_AFFINITY.items()))}),
risk(name, r) as (values {_values(list(R.COUNTRY_RISK.items()))}), base as (select *, coalesce(finbert, sentiment) as raw from events_),
emitted as (select b.id, t.symbol from base b join topic t on list_contains(string_split(b.topics, ','), t.slug) union select b.id, r.symbol from base b join rule r on r.cat = b.category and (r.region = '' or contains(lower(coalesce(b.location_name, '')), r.region))),
panel as (select distinct id, symbol from emitted where symbol in ('CL=F', 'GC=F', 'BTC-USD', 'SPY', 'EURUSD=X')),
f as (select b.id, p.symbol, coalesce(s.a, 0.6)::double as sub, coalesce(a.a, 0.6)::double as aff, (select max(r)::double from (select 0.5 as r union all select r from risk where contains(lower(coalesce(b.location_name, '')), name))) as risk,
 case when raw > 0 and category in ('conflict', 'disaster') then raw * 0.5 else raw end as adj, intensity from base b join panel p using (id) left join sub s on s.name = b.sub_category left join affinity a on a.cat = b.category and a.symbol = p.symbol),
g as (select *, case when adj is null then 0.5 when adj < 0 then greatest(-1.5, adj * 1.5) else greatest(0.3, adj) end::double as sent, case when intensity is null then 1.0 else 0.6 + 0.4 * greatest(0, least(intensity, 1)) end::double as sev from f)
select id, symbol, round_even(case when (sent >= 0) = (aff >= 0) then 1.0 else -1.0 end::double * least(sub * abs(aff) * risk * greatest(least(abs(sent), 1), 0.1::double) * sev, 1), 4) as weight from g"""


@query("j17_j19_c07_c12_routing", ROUTE)
def _(spark, d):
    e = load(spark, d, "events").withColumn("topic_slugs", F.split("topics", ",")).withColumn("sub_categories", F.array("sub_category")).withColumn("route_sentiment", F.coalesce("finbert", "sentiment"))
    return R.route(e).select("id", "symbol", "weight")


@query("j20_panel_grid", "select c.c_mktsegment as segment, p.p_brand as brand, count(*) filter (where s.k is not null) as hits from (select distinct c_mktsegment from customer) c, (select distinct p_brand from part) p left join (select distinct c_mktsegment as k, 'Brand#11' as b from customer) s on s.k = c.c_mktsegment and s.b = p.p_brand group by 1, 2")
def _(spark, d):
    seg = load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    brand = load(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    hit = seg.select("segment", F.lit("Brand#11").alias("brand"), F.lit(1).alias("k"))
    # The full grid is the result: five segments by a fixed set of brands.
    return seg.crossJoin(F.broadcast(brand)).join(hit, ["segment", "brand"], "left").groupBy("segment", "brand").agg(F.count("k").alias("hits"))


@query("j21_outer_align", BA + """ select d, max(close) filter (where symbol = '1-URGENT') as urgent, max(close) filter (where symbol = '2-HIGH') as high from bars_ where symbol in ('1-URGENT', '2-HIGH') group by 1""")
def _(spark, d):
    p = load(spark, d, "bars").where("symbol in ('1-URGENT', '2-HIGH')").groupBy("d").pivot("symbol", ["1-URGENT", "2-HIGH"]).agg(F.max("close"))
    return p.select("d", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"))


@query("j22_latency_pairs", "select o_orderpriority as k, count(*) as n, avg(date_diff('day', o_orderdate, l_shipdate)) as days from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= o_orderdate group by 1")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    j = load(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate")
    return j.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), F.avg(F.datediff("l_shipdate", "o_orderdate")).alias("days"))


@query("j23_t14_layers", EV + """, u as (select 'event' as layer, floor(latitude / 30)::bigint as y from events_ union all select 'point', (s_suppkey % 6 - 3)::bigint from supplier) select y, count(*) filter (where layer = 'event') as events, count(*) filter (where layer = 'point') as points from u group by 1""")
def _(spark, d):
    e = load(spark, d, "events").select(F.lit("event").alias("layer"), F.floor(F.col("latitude") / 30).alias("y"))
    u = e.unionByName(load(spark, d, "supplier").select(F.lit("point").alias("layer"), (F.col("s_suppkey") % 6 - 3).alias("y")))
    return u.groupBy("y").agg(F.count_if(F.col("layer") == "event").alias("events"), F.count_if(F.col("layer") == "point").alias("points"))


@query("s27_s30_insert_new", "select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0 union all select min(c_custkey), min(c_name) from customer where c_custkey % 2 = 1 and c_custkey % 3 = 0 group by c_custkey")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    incoming = c.where("id % 3 = 0")
    return insert_new(c.where("id % 2 = 0"), incoming.unionByName(incoming), ["id"])

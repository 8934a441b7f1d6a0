"""Stage predicates, decisions and small reads as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import decisions as D
from ..functions import parsing as P
from ..functions import text as T
from ..operators.vectors import best_matches
from ..registry import query
from ..sources.html import page_bodies
from ..streaming import windows as W
from .filters import capped

EV, AR, BA, FC = cte("events"), cte("articles"), cte("bars"), cte("forecasts")
NOW = 1704067200 + 600_000

STAGED = AR + f""", x as (select id, stage, source_code, content, title, city, published_s as created, case id % 4 when 1 then {NOW} - 25200 when 2 then {NOW} - 21600 when 3 then {NOW} - 3600 end as queued,
 case id % 11 when 0 then true when 1 then null else false end as deferred, id % 13 = 0 as backfill from articles_)"""


def staged(spark, d) -> DataFrame:
    i = F.col("id")
    queued = F.when(i % 4 == 1, NOW - 25_200).when(i % 4 == 2, NOW - 21_600).when(i % 4 == 3, NOW - 3_600)
    return load(spark, d, "articles").withColumns({"created": F.col("published_s"), "queued": queued, "deferred": F.when(i % 11 == 0, True).when(i % 11 != 1, False), "backfill": i % 13 == 0})


@query("f25_f26_f27_article_stages", STAGED + f""" select id, deferred is distinct from true and (queued is null or queued < {NOW} - 6 * 3600) as free, stage = 'fetched' and deferred is distinct from true and (queued is null or queued < {NOW} - 21600) and created >= {NOW} - 21600 and not backfill as analyze,
 stage = 'fetched' and deferred is distinct from true and (queued is null or queued < {NOW} - 21600) and (created < {NOW} - 21600 or backfill) as annotate, stage = 'refine' and deferred is distinct from true as refine from x""")
def _(spark, d):
    s = D.article_stages(*map(F.col, ("stage", "queued", "created", "deferred", "backfill")), F.lit(NOW))
    return staged(spark, d).select("id", s.alias("s")).select("id", "s.*")


TAGGED = EV + """, x as (select id, floor(epoch(started_at))::bigint as s, case id % 5 when 1 then '{}' when 2 then '["war"]' when 3 then '{"war": 0.7}' when 4 then '' end as tags, case id % 3 when 0 then 'embed' when 1 then 'keyword' else '' end as topics_source, id % 7 <> 0 as is_routed from events_)"""
LATE = 1706400000


def tagged(spark, d) -> DataFrame:
    i = F.col("id")
    tags = F.when(i % 5 == 1, "{}").when(i % 5 == 2, '["war"]').when(i % 5 == 3, '{"war": 0.7}').when(i % 5 == 4, "")
    source = F.when(i % 3 == 0, "embed").when(i % 3 == 1, "keyword").otherwise("")
    return load(spark, d, "events").select("id", F.unix_timestamp("started_at").alias("s"), tags.alias("tags"), source.alias("topics_source"), (i % 7 != 0).alias("is_routed"))


@query("f25_f28_event_stages", TAGGED + f""" select id, s >= {LATE} - 168 * 3600 and topics_source <> 'embed' and (tags is null or tags in ('', '{{}}') or tags[1] = '[' or topics_source = 'keyword') as tag, s >= {LATE} - 604800 and not is_routed as route from x""")
def _(spark, d):
    s = D.event_stages(F.col("s"), F.col("tags"), F.col("topics_source"), F.col("is_routed"), F.lit(LATE))
    return tagged(spark, d).select("id", s.alias("x")).select("id", "x.*")


@query("f31_stage_and_gap_filters", TAGGED.replace("with ", "with a0 as (select 1), ", 1) + ", " + STAGED.removeprefix("with ").replace(", x as (", ", y as (") + """ select 'refine' as name, count(*) as n from y where stage = 'refine' union all select 'unlocated', count(*) from y where stage in ('annotated', 'refined') and city is null union all select 'any', count(*) from y
 union all select 'untagged', count(*) from x where topics_source = '' union all select 'keyword', count(*) from x where topics_source = 'keyword' union all select 'unrouted', count(*) from x where not is_routed""")
def _(spark, d):
    a, e = staged(spark, d).withColumn("location", F.col("city")), tagged(spark, d)
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out = count(D.at_stage(a, "refine"), "refine").unionByName(count(D.at_stage(a, "unlocated"), "unlocated")).unionByName(count(D.at_stage(a, None), "any"))
    for gap in ("untagged", "keyword", "unrouted"):
        out = out.unionByName(count(D.at_gap(e, gap), gap))
    return out


@query("f34_reprocess_scopes", STAGED + """ select 'deferred' as scope, id from x where deferred and queued is null union all select 'unfinished', id from x where stage = 'fetched' union all select 'everything', id from x""")
def _(spark, d):
    a = staged(spark, d).withColumnsRenamed({"deferred": "annotation_deferred", "queued": "processed_on"})
    scopes = [D.in_scope(a, s).select(F.lit(s).alias("scope"), "id") for s in ("deferred", "unfinished", "everything")]
    return scopes[0].unionByName(scopes[1]).unionByName(scopes[2])


@query("a22_stage_health", "select p_partkey as id, not coalesce(p_size % 4 > 0 and case when p_size % 7 > 0 then 1000000 - p_size * 100 end < 1000000 - 3 * (p_size % 10) * 60, false) as ok from part")
def _(spark, d):
    z = F.col("p_size")
    ok = D.stage_health(z % 4, F.when(z % 7 > 0, 1_000_000 - z * 100), z % 10, F.lit(1_000_000))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), ok.alias("ok"))


@query("a23_provider_health", """with p as (select o_orderpriority as provider, o_custkey % 50 as k, max(epoch(o_orderdate)::bigint) filter (where o_orderstatus = 'F') as ok_s, max(epoch(o_orderdate)::bigint) filter (where o_orderstatus = 'O') as err_s from orders group by 1, 2)
select provider, k, not (coalesce(err_s >= 980000000 - 1800 * 3600, false) and not coalesce(ok_s >= 980000000 - 1800 * 3600, false)) as ok from p""")
def _(spark, d):
    at = F.unix_timestamp("o_orderdate")
    p = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("provider"), (F.col("o_custkey") % 50).alias("k")).agg(F.max(F.when(F.col("o_orderstatus") == "F", at)).alias("ok_s"), F.max(F.when(F.col("o_orderstatus") == "O", at)).alias("err_s"))
    return p.select("provider", "k", D.provider_health(F.col("ok_s"), F.col("err_s"), 1_800, F.lit(980_000_000)).alias("ok"))


@query("r13_r14_reap_and_prune", EV + " select id, case when id % 2 = 0 and s < 1706400000 - 12 * 3600 then 'failed' when id % 2 = 0 then 'running' else 'done' end as status from (select id, floor(epoch(started_at))::bigint as s from events_) where s >= 1706400000 - 14 * 86400")
def _(spark, d):
    e = load(spark, d, "events").select("id", F.unix_timestamp("started_at").alias("s")).where(F.col("s") >= LATE - 14 * 86_400)
    return e.select("id", D.run_status(F.when(F.col("id") % 2 == 0, "running").otherwise("done"), F.col("s"), F.lit(LATE), 12).alias("status"))


@query("r04_reaggregation", EV + f""", w as (select floor((({LATE}) - h * 3600) / 259200)::bigint * 259200 as a, h from (values (72), (168)) t(h)) select h::int as hours, location_name, floor(epoch(started_at) / 259200)::bigint * 259200 as cell, count(*) as n from events_ join w on epoch(started_at) >= a and epoch(started_at) < {LATE} where location_name is not null group by 1, 2, 3""")
def _(spark, d):
    e = load(spark, d, "events").where("location_name is not null").select("location_name", (F.unix_micros("started_at") / 1e6).alias("s"))

    def window(hours: int) -> DataFrame:
        a, b = W.reaggregation_windows(F.lit(LATE), hours)
        return e.where((F.col("s") >= a) & (F.col("s") < b)).groupBy(F.lit(hours).alias("hours"), "location_name", (F.floor(F.col("s") / 259_200) * 259_200).alias("cell")).agg(F.count("*").alias("n"))

    return window(72).unionByName(window(168))


@query("r04_tiles", """with t as (select o_custkey as id, min(epoch(o_orderdate)::bigint) as a, max(epoch(o_orderdate)::bigint) as b from orders group by 1)
select id, unnest(range(a // 2592000 * 2592000, greatest(a // 2592000 * 2592000, b - 1) + 1, 2592000)) as start_s from t""")
def _(spark, d):
    at = F.unix_timestamp("o_orderdate")
    t = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return t.select("id", F.explode(W.tiles(F.col("a"), F.col("b"))).alias("t")).select("id", F.col("t.start").alias("start_s"))


@query("r09_cadence", "select p_partkey as id, p_size % 5 = 0 or 1000000 - (1000000 - p_size * 100) >= (p_size % 60) * 60 as due from part")
def _(spark, d):
    z = F.col("p_size")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), W.is_due(F.when(z % 5 != 0, 1_000_000 - z * 100), F.lit(1_000_000), z % 60).alias("due"))


@query("s18_page_bodies")
def _(spark, d):
    return page_bodies(load(spark, d, "pages"), "page_id", "html")


@query("s19_rehydration", STAGED.replace(", x as", ", x0 as", 1) + f""", x as (select *, lower(regexp_extract(content, '(?i){T.PAYWALL}')) as m, case when id % 9 = 0 then '' else 'http://x' end as url, case id % 6 when 0 then 'ft-world' else source_code end as src from x0)
select id, case when url = '' then 'skip' when length(content) >= 600 and not (m <> '' and strpos(lower(content), m) - 1 <= length(content) * 0.6) then 'keep' when src = 'ft-world' then 'delete' else 'fetch' end as what from x""")
def _(spark, d):
    a = staged(spark, d)
    source, url = F.when(F.col("id") % 6 == 0, "ft-world").otherwise(F.col("source_code")), F.when(F.col("id") % 9 == 0, "").otherwise("http://x")
    return a.select("id", D.rehydration(F.col("content"), source, url).alias("what"))


@query("c06_section_category", AR + " select id, case " + " ".join(f"when contains(h, '{k}') then '{c}'" for k, c in D.SECTION_CATEGORY) + " else 'general' end as category from (select id, lower(coalesce(title, '') || ' ' || ['Armed clashes','Law and crime','Business','Arts','Elections','Floods','Energy news'][1 + (id % 7)::int]) as h from articles_)")
def _(spark, d):
    names = F.array(*map(F.lit, ("Armed clashes", "Law and crime", "Business", "Arts", "Elections", "Floods", "Energy news")))
    heading = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.element_at(names, (F.col("id") % 7 + 1).cast("int")))
    return load(spark, d, "articles").select("id", D.section_category(heading).alias("category"))


@query("s06_images", """select event_id as id, case when event_id % 4 = 0 then 'http://a/c.bin' when event_id % 4 = 1 and event_id % 3 = 0 then 'http://a/c.JPG?x=1' when event_id % 5 < 2 then 'http://a/t' when event_id % 7 < 3 then 'http://a/e' end as image from events""")
def _(spark, d):
    i = F.col("id")
    item = lambda **c: F.array(F.struct(*[v.alias(k) for k, v in c.items()]))
    url = F.when(i % 4 == 0, "http://a/c.bin").when(i % 4 == 1, F.when(i % 3 == 0, "http://a/c.JPG?x=1").otherwise("http://a/c.mp4")).otherwise("")
    contents = item(url=url, medium=F.when(i % 4 == 0, "image"))
    return load(spark, d, "events").select("id", D.image_of(contents, item(url=F.when(i % 5 < 2, "http://a/t")), item(type=F.when(i % 7 < 3, "image/png").otherwise("audio/mpeg"), href=F.lit("http://a/e"))).alias("image"))


@query("c29_event_translations", AR + """ select id, case when id % 3 = 0 then 'ar ' || title else title end as title, case when city is not null and id % 4 <> 0 then city || ', ' || country when city is not null then country else 'somewhere' end as location_name from articles_""")
def _(spark, d):
    fields = F.struct(F.when(F.col("id") % 3 == 0, F.concat(F.lit("ar "), "title")).otherwise("").alias("title"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("city")).alias("city"), F.col("country").alias("country"))
    t = D.event_translations(F.create_map(F.lit("ar"), fields), F.col("title"), F.lit("somewhere"))
    return load(spark, d, "articles").select("id", t["ar"].alias("t")).select("id", "t.*")


@query("s21_s22_quotes", BA + """, p as (select symbol, d, case when day(d) % 7 = 0 then null when day(d) % 11 = 0 then 0 else close end as price, lag(close) over (partition by symbol order by d) as prev from bars_)
select symbol, d, case when price is null and prev is null then null when coalesce(price, 0) <> 0 then price else prev end as value, case when price is not null and prev <> 0 then round_even((price - prev) / prev * 100, 4) end as change_pct from p""")
def _(spark, d):
    day = F.dayofmonth("d")
    b = load(spark, d, "bars").select("symbol", "d", F.when(day % 7 == 0, None).when(day % 11 == 0, 0.0).otherwise(F.col("close")).alias("price"), F.lag("close").over(Window.partitionBy("symbol").orderBy("d")).alias("prev"))
    return b.select("symbol", "d", D.quote(F.col("price"), F.col("prev")).alias("q")).select("symbol", "d", "q.*")


@query("c40_signed_score", EV + " select id, round_even(coalesce(abs(finbert), 0) * 0.9 - coalesce(abs(sentiment), 0) * 0.7, 4) as score from events_")
def _(spark, d):
    s = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("score"))
    zero = F.lit(0.0)
    scores = F.array(s("Positive", F.coalesce(F.abs("finbert"), zero) * 0.9), s("neutral", F.lit(0.5)), s("NEGATIVE", F.coalesce(F.abs("sentiment"), zero) * 0.7))
    return load(spark, d, "events").select("id", D.signed_score(scores).alias("score"))


@query("c04_u07_u08_prototypes", """with p as (select arg_min(embedding, vec_id)::double[] as proto, label as cat from embeddings where label is not null group by label),
s as (select e.vec_id, p.cat, list_cosine_similarity(e.embedding::double[], p.proto) as s from embeddings e, p),
g as (select vec_id, arg_max(cat, (s, -cat)) as best, max(s) as score, arg_max(cat, (s, -cat)) filter (where cat <> 0) as spec, max(s) filter (where cat <> 0) as spec_s from s group by 1)
select vec_id, case when best = 0 and spec_s >= 0.30 and score - spec_s <= 0.04 then spec when best = 0 then 0 else best end::varchar as category, case when score >= 0.25 then best::varchar else 'other' end as sub, case when score >= 0.42 then round_even(least(1, 0.5 + (score - 0.42)), 3) end as confidence from g""")
def _(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    proto = e.where("label is not null").groupBy(F.col("label").alias("key")).agg(F.min_by("vector", "id").alias("vector"))
    s = best_matches(e.select("id", "vector"), proto, 0.42, general=0)
    name = lambda c: F.when(F.col(c) == 0, "general").otherwise(F.col(c).cast("string"))
    category = D.tie_break(name("best"), F.col("score"), name("specific"), F.col("specific_score"))
    sub = D.sub_category(F.col("best").cast("string"), F.col("score"))
    return s.select(F.col("id").alias("vec_id"), F.when(category == "general", "0").otherwise(category).alias("category"), sub.alias("sub"), D.match_confidence(F.col("score")).alias("confidence"))


@query("c38_forecast_decision", FC + """, x as (select id, 100 + id % 50 as close, direction_prob as p, coalesce(realized_return, 0) / 10 as r from forecasts_)
select id, round_even(p, 4) as proba_up, case when p > 0.55 then 'up' when p < 0.45 then 'down' else 'neutral' end as direction, round_even(r * 100, 4) as predicted_change_pct, round_even(close * (1 + r), 4) as predicted_price, round_even(close * (1 + r - 0.02::double), 4) as band_low, round_even(close * (1 + r + 0.02::double), 4) as band_high, round_even(abs(p - 0.5::double) * 2, 4) as confidence, round_even(close::double, 4) as current_value from x""")
def _(spark, d):
    x = D.decision((100 + F.col("id") % 50).cast("double"), F.col("direction_prob"), F.coalesce("realized_return", F.lit(0.0)) / 10, F.lit(0.02))
    return load(spark, d, "forecasts").select("id", x.alias("x")).select("id", "x.*")


@query("c45_projection", cte("bars", "forecasts") + """, f as (select symbol, arg_max({'d': generated_at::date, 'h': horizon_days, 'p': direction_prob}, (generated_at, id)) as f from forecasts_ group by 1), l as (select symbol, max(d) as last from bars_ group by 1)
select b.symbol, b.d as date, b.close, case when b.d = l.last then b.close end as projection, null::double as low from bars_ b join l using (symbol) union all select symbol, f.f.d + f.f.h, null, f.f.p * 1000, f.f.p * 1000 - 50 from f""")
def _(spark, d):
    f = load(spark, d, "forecasts").groupBy("symbol").agg(F.max_by(F.struct(F.to_date("generated_at").alias("as_of"), "horizon_days", (F.col("direction_prob") * 1000).alias("predicted_price")), F.struct("generated_at", "id")).alias("f"))
    f = f.select("symbol", "f.*").withColumns({"band_low": F.col("predicted_price") - 50, "band_high": F.col("predicted_price") + 50})
    return D.projection(load(spark, d, "bars"), f).select("symbol", "date", "close", "projection", F.get("band", F.lit(0)).alias("low"))


@query("c36_notices", """select s_suppkey as id, 'F' || (s_suppkey % 3)::varchar || '/' || s_suppkey::varchar as notam_id, case when s_suppkey % 5 < 2 and s_suppkey % 5 <> 4 then 'expired' else 'active' end as status, case when s_suppkey % 2 = 0 then 40.5 else 10.25 end::double as latitude, case when s_suppkey % 2 = 0 then 20.0 else -3.5 end::double as longitude, 5::double as radius_nm from supplier where s_suppkey % 4 <> 3""")
def _(spark, d):
    k = F.col("s_suppkey")
    line = F.when(k % 2 == 0, "Q) UUWV/QRTCA/IV/BO/W/000/120/4030N02000E005")
    s = load(spark, d, "supplier").select(k.alias("id"), P.q_line(line).alias("q"))
    i = F.col("id")
    number = F.when(i % 4 != 3, i.cast("string"))
    n = D.notice(number, F.concat(F.lit("F"), (i % 3).cast("string")), F.col("q"), F.struct(F.lit(10.25).alias("latitude"), F.lit(-3.5).alias("longitude")), F.lit(None).cast("long"), F.when(i % 5 != 4, 1_000 + (i % 5) * 10), F.lit(1_020))
    return s.select("id", n.alias("n")).where("n is not null").select("id", "n.notam_id", "n.status", "n.latitude", "n.longitude", "n.radius_nm")


@query("c48_quakes", EV + """ select id, case when m >= 2 then greatest(4, floor(pow(m - 2, 1.6) + 0.5)) end::double as radius, case when id % 10 = 0 then '#e05252' when id % 5 = 1 then '#e05252' when id % 5 = 2 then '#e09652' when id % 5 = 3 then '#e0c852' when id % 5 = 4 then '#52c8a0' else '#7c6ef8' end as colour from (select id, (id % 100) / 10 as m from events_)""")
def _(spark, d):
    i = F.col("id")
    alert = F.when(i % 5 == 1, "Red").when(i % 5 == 2, "ORANGE").when(i % 5 == 3, "yellow").when(i % 5 == 4, "green").otherwise("")
    return load(spark, d, "events").select("id", D.quake_radius((i % 100) / 10).alias("radius"), D.quake_colour(alert, i % 10 == 0).alias("colour"))


@query("c49_flags", "select n_nationkey as id, 127397 + ascii(upper(n_name[1])) as first, 127397 + ascii(upper(n_name[2])) as second from nation")
def _(spark, d):
    p = D.flag_points(F.lower(F.substring("n_name", 1, 2)))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.get(p, F.lit(0)).alias("first"), F.get(p, F.lit(1)).alias("second"))


@query("c41_shortened", """with w as (select doc_id, string_split(coalesce(text, ''), ' ') as a from documents)
select doc_id, array_to_string(list_concat(list_transform(a[1:20], lambda x: x[1:200]), case when len(a) > 20 then ['...+' || (len(a) - 20)::varchar || ' more'] else [] end), '|') as shown from w""")
def _(spark, d):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return load(spark, d, "documents").select("doc_id", F.array_join(D.shortened(words), "|").alias("shown"))


@query("t21_sampled_days", """with m as (select (y::varchar || '-' || lpad(m::varchar, 2, '0') || '-01')::date as month from range(1995, 2027) t(y), (values (1), (4), (7), (10)) u(m)), n as (select c_custkey as id, date '1995-06-15' + (c_custkey * 7 % 9000)::int as now from customer)
select id, month, month + ((date_diff('day', date '2000-01-01', month) * 7919 + 5) % w + case when (date_diff('day', date '2000-01-01', month) * 7919 + 5) % w < 0 then w else 0 end)::int as day from (select *, greatest(1, date_diff('day', month, least((month + interval 1 month)::date, now))) as w from n join m on month < now)""")
def _(spark, d):
    n = load(spark, d, "customer")
    now = F.date_add(F.lit("1995-06-15").cast("date"), (F.col("c_custkey") * 7 % 9000).cast("int"))
    return n.select(F.col("c_custkey").alias("id"), F.explode(D.sampled_days(1995, 2026, 4, now, 5)).alias("s")).select("id", "s.*")


def recent_scored(forecasts: DataFrame, n: str | int | None = None) -> DataFrame:
    """The last forecasts that have an outcome: 10 by default, 1 to 50."""
    return forecasts.where("realized_return is not null").orderBy(F.desc("generated_at"), F.desc("id")).limit(max(1, capped(n, 10, 50)))


@query("t09_recent_scored", FC + " select id, direction_prob from forecasts_ where realized_return is not null order by generated_at desc, id desc limit 50")
def _(spark, d):
    return recent_scored(load(spark, d, "forecasts"), "500").select("id", "direction_prob")


def enabled(rows: DataFrame, flag: str, order: str, kind: str | None = None, kind_column: str = "kind") -> DataFrame:
    """The reads of sources, symbols and static points: rows that are switched on, of a kind if one is asked for, in order."""
    rows = rows.where(F.col(flag))
    return (rows.where(F.col(kind_column) == kind) if kind else rows).orderBy(order)


@query("api_sources_symbols_points", cte("sources") + """ select 'source' as kind, code as name from sources_ where not weight_locked union all select 'symbol', p_name || p_partkey::varchar from part where p_size % 2 = 0 union all select 'point', s_name from supplier where s_nationkey = 3 and s_acctbal > 0""")
def _(spark, d):
    sources = enabled(load(spark, d, "sources").withColumn("is_enabled", ~F.col("weight_locked")), "is_enabled", "code").select(F.lit("source").alias("kind"), F.col("code").alias("name"))
    symbols = enabled(load(spark, d, "part").withColumn("is_active", F.col("p_size") % 2 == 0), "is_active", "p_partkey").select(F.lit("symbol").alias("kind"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    points = enabled(load(spark, d, "supplier").withColumn("is_active", F.col("s_acctbal") > 0), "is_active", "s_suppkey", 3, "s_nationkey").select(F.lit("point").alias("kind"), F.col("s_name").alias("name"))
    return sources.unionByName(symbols).unionByName(points)

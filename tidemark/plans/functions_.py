"""Scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import decisions as D
from ..functions import parsing as P
from ..functions import routing as R
from ..functions import text as T
from ..operators.sentiment import fitted_lexicon, lexicon_sentiment
from ..registry import query
from .joins_ import TOK

EV, AR = cte("events"), cte("articles")


@query("c01_tokens", f"select doc_id, len({TOK.format('text')}) as n, array_to_string(list_sort({TOK.format('text')}), ' ') as words from documents")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.array_sort(T.tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("words"))


@query("c02_jaccard", f"""with a as (select doc_id, {TOK.format('text')} as x, lead({TOK.format('text')}) over (order by doc_id) as y from documents)
select doc_id, case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) else 0 end::double as j from a where y is not null""")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("x"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return t.join(n, "doc_id").select("doc_id", T.jaccard(F.col("x"), F.col("y")).alias("j"))


@query("c05_texts", AR + " select id, title || ' — ' || coalesce(nullif(city, ''), 'nowhere') || coalesce(' — ' || category, '') as t from articles_ where title is not null")
def _(spark, d):
    return load(spark, d, "articles").where("title is not null").select("id", F.concat_ws(" — ", "title", F.coalesce(F.nullif("city", F.lit("")), F.lit("nowhere")), "category").alias("t"))


@query("c06_slug", r"select p_partkey as id, substr(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) as slug from part")
def _(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"))


@query("c08_c10_sentiment", EV + """ select id, case when coalesce(finbert, sentiment) is null then 0.5 when s < 0 then greatest(-1.5, s * 1.5) else greatest(0.3, s) end::double as s from (select *, case when coalesce(finbert, sentiment) > 0 and category in ('conflict', 'disaster') then coalesce(finbert, sentiment) * 0.5 else coalesce(finbert, sentiment) end as s from events_)""")
def _(spark, d):
    return load(spark, d, "events").select("id", R.asymmetric_sentiment(R.adjusted_sentiment(F.col("category"), F.coalesce("finbert", "sentiment"))).alias("s"))


@query("c13_importance", cte("articles", "sources") + """ select a.id, round_even(greatest(1, least(10, greatest((1 + 9 * a.intensity) * coalesce(s.weight, 1.0) + 0.5, case category when 'conflict' then 6 when 'disaster' then 6 when 'health' then 5 when 'political' then 4 when 'economic' then 4 else 0 end)))::double, 2) as importance
 from articles_ a left join sources_ s on s.code = a.source_code where a.intensity is not null""")
def _(spark, d):
    a = load(spark, d, "articles").where("intensity is not null").join(load(spark, d, "sources"), F.col("source_code") == F.col("code"), "left")
    return a.select("id", R.importance(F.col("intensity"), F.col("weight"), F.lit(0.5), F.col("category")).alias("importance"))


@query("c15_lexical_intensity", r"""with t as (select event_id as id, case event_id % 5 when 0 then 'Opinion: ' else '' end || 'At least ' || (event_id % 300)::varchar || case event_id % 3 when 0 then ' people killed' when 1 then ' wounded' else ' paid' end || case event_id % 4 when 0 then ' in magnitude 6.' || (event_id % 10)::varchar || ' quake' when 1 then ' in magnitude 7 quake, a historic loss' else '' end as x from events)
select id, round_even(greatest(0, least(1, 0.7 + case when event_id_c >= 100 then 0.25 when event_id_c >= 10 then 0.15 when event_id_c is not null then 0.05 else 0 end + case id % 4 when 0 then 0.15 when 1 then 0.35 else 0 end - case id % 5 when 0 then 0.15 else 0 end))::double, 4) as intensity from (select *, case when id % 3 < 2 then id % 300 end as event_id_c from t)""")
def _(spark, d):
    x = F.concat(
        F.when(F.col("id") % 5 == 0, "Opinion: ").otherwise(""), F.lit("At least "), (F.col("id") % 300).cast("string"),
        F.when(F.col("id") % 3 == 0, " people killed").when(F.col("id") % 3 == 1, " wounded").otherwise(" paid"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit(" in magnitude 6."), (F.col("id") % 10).cast("string"), F.lit(" quake"))).when(F.col("id") % 4 == 1, " in magnitude 7 quake, a historic loss").otherwise(""),
    )
    e = load(spark, d, "events").select("id", x.alias("x"))
    return e.select("id", R.intensity(F.lit("conflict"), F.lit("war"), T.lexical_severity(F.col("x"))).alias("intensity"))


@query("c16_summary")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("c19_c20_city_index", "select lower(c_mktsegment) as name, arg_max(c_custkey, (c_acctbal, -c_custkey)) as id from customer group by 1")
def _(spark, d):
    return load(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("id"))


@query("c25_json_items", """select event_id as id, case event_id % 5 when 3 then 0 when 2 then 2 else 1 end as n, case event_id % 5 when 3 then 0 when 2 then try_cast(json_extract_string(props, '$.k') as bigint) + 7 when 4 then -1 else coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) end as k from events""")
def _(spark, d):
    props, i = F.col("props"), F.col("event_id") % 5
    reply = F.when(i == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(i == 2, F.concat(F.lit("["), props, F.lit(', {"k": 7}]'))).when(i == 3, "I can't tell.").when(i == 4, '[{"other": 1}]').otherwise(props)
    items = P.json_items(reply, "k bigint")
    # An item without a number counts as -1.
    total = F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["k"], F.lit(-1)))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.size(items).cast("long").alias("n"), total.alias("k"))


@query("c26_usage_split", "select o_orderkey as id, i, o_custkey // (1 + o_orderkey % 5) + case when i < o_custkey % (1 + o_orderkey % 5) then 1 else 0 end as tokens from (select *, unnest(range(0, 1 + o_orderkey % 5)) as i from orders)")
def _(spark, d):
    n = 1 + F.col("o_orderkey") % 5
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return o.select("id", "i", D.usage_share(F.col("o_custkey"), F.col("n"), F.col("i")).alias("tokens"))


@query("c27_status_merge", EV + " select id, case when id % 2 = 0 then 'ok' else 'failed' end as route, 'ok' as tag, case when id % 2 = 1 then 'late' end as error from events_")
def _(spark, d):
    entry = lambda ok, err: F.struct(ok.alias("ok"), F.col("started_at").alias("at"), err.alias("error"))
    old = F.create_map(F.lit("tag"), entry(F.lit(True), F.lit(None).cast("string")), F.lit("route"), entry(F.lit(False), F.lit("old")))
    s = P.merge_status(old, F.lit("route"), F.col("id") % 2 == 0, F.col("started_at"), F.lit("late"))
    word = lambda k: F.when(F.col("s")[k]["ok"], "ok").otherwise("failed")
    return load(spark, d, "events").select("id", s.alias("s")).select("id", word("route").alias("route"), word("tag").alias("tag"), F.col("s")["route"]["error"].alias("error"))


@query("c28_translation_fallback", AR + " select id, case when id % 3 = 0 then 'ar ' || title else title end as shown from articles_")
def _(spark, d):
    m = F.create_map(F.lit("ar"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("ar "), "title")).otherwise(""))
    return load(spark, d, "articles").select("id", F.coalesce(F.nullif(m["ar"], F.lit("")), "title").alias("shown"))


@query("c30_c31_grid_and_windows", EV + " select id, floor(epoch(started_at) / 259200)::bigint * 3 as cell, started_at::date as day from events_")
def _(spark, d):
    return load(spark, d, "events").select("id", (F.floor(F.unix_timestamp("started_at") / 259200) * 3).alias("cell"), F.to_date("started_at").alias("day"))


@query("c32_c33_dates", """select o_orderkey as id, case o_orderkey % 3 when 0 then date_trunc('month', o_orderdate)::date when 1 then date_trunc('year', o_orderdate)::date end as approx, case when o_orderkey % 2 = 0 then epoch(date_trunc('day', o_orderdate))::bigint end as notice_s from orders""")
def _(spark, d):
    o = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(o, "MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(o, "yyyy")).otherwise("soon")
    notice = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(o, "yyMMdd'0000'"))
    # Orders begin in 1995: a two-digit year reads as of this century, and is set back.
    at = F.add_months(F.to_date(P.notice_time(notice)), F.when(F.year(o) < 2000, -1200).otherwise(0))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), P.approximate_date(text).alias("approx"), F.unix_timestamp(at.cast("timestamp")).alias("notice_s"))


@query("c34_c35_notices", """select s_suppkey as id, 'UUWV' as region, (s_suppkey % 90 + (s_suppkey % 60) / 60) * case when s_suppkey % 2 = 0 then 1 else -1 end as latitude, (s_suppkey % 180 + (s_suppkey % 60) / 60) * case when s_suppkey % 3 = 0 then -1 else 1 end as longitude, (s_suppkey % 450) * 100::double as upper_ft, 33::bigint as ring from supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    two, three = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.lpad(c.cast("string"), 3, "0"))
    line = F.concat(F.lit("Q) UUWV/QRTCA/IV/BO/W/000/"), three(k % 450), F.lit("/"), two(k % 90), two(k % 60), F.when(k % 2 == 0, "N").otherwise("S"), three(k % 180), two(k % 60), F.when(k % 3 == 0, "W").otherwise("E"), F.lit("005"))
    q = load(spark, d, "supplier").select(k.alias("id"), P.q_line(line).alias("q"))
    return q.select("id", "q.region", "q.latitude", "q.longitude", "q.upper_ft", F.size(P.circle(F.col("q.latitude"), F.col("q.longitude"), F.col("q.radius_nm"))).cast("long").alias("ring"))


@query("c37_change_pct", cte("bars") + " select symbol, d, round_even((close - p) / p * 100, 4) as pct from (select *, lag(close) over (partition by symbol order by d) as p from bars_)")
def _(spark, d):
    b = load(spark, d, "bars").withColumn("p", F.lag("close").over(Window.partitionBy("symbol").orderBy("d")))
    return b.select("symbol", "d", P.change_pct(F.col("close"), F.col("p")).alias("pct"))


@query("c42_strip_html", r"""select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) as h from pages""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("h"))


@query("c43_strip_citations", r"select p_partkey as id, trim(p_name) as t from part")
def _(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), T.strip_citations(F.concat("p_name", F.lit(" (Reuters) (AP, via BBC) "))).alias("t"))


@query("c44_c48_numbers", """select l_orderkey as id, l_linenumber as line, case when f <= 1 then 1.0 when f <= 2 then 2.0 when f <= 5 then 5.0 else 10.0 end::double * b as nice, floor(l_quantity - 25.5 + 0.5)::bigint as r from (select *, pow(10, floor(log10(l_quantity))) as b, l_quantity / pow(10, floor(log10(l_quantity))) as f from lineitem)""")
def _(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), P.nice_max(F.col("l_quantity")).alias("nice"), P.js_round(F.col("l_quantity") - 25.5).alias("r"))


@query("c46_c50_markers", EV + """ select id, 4 + least(abs(sentiment) * (0.5 + coalesce(intensity, 0)), 1.5) * 4 as size, case category when 'economic' then 'eco' when 'conflict' then 'war' end as stream_key from events_ where sentiment is not null""")
def _(spark, d):
    size = 4 + F.least(F.abs("sentiment") * (0.5 + F.coalesce("intensity", F.lit(0.0))), F.lit(1.5)) * 4
    return load(spark, d, "events").where("sentiment is not null").select("id", size.alias("size"), R.lookup({"economic": "eco", "conflict": "war"}, F.col("category")).alias("stream_key"))


@query("c47_digest_text", EV + """ select category, '## ' || upper(substr(category, 1, 1)) || substr(category, 2) || chr(10) || string_agg('- ' || sub_category || ' in ' || coalesce(location_name, 'unknown') || ' (' || article_count::varchar || ')', chr(10) order by article_count desc, id) as body from events_ where started_at::date = date '2024-01-10' group by 1""")
def _(spark, d):
    e = load(spark, d, "events").where("to_date(started_at) = date '2024-01-10'")
    line = F.concat(F.lit("- "), "sub_category", F.lit(" in "), F.coalesce(F.nullif("location_name", F.lit("")), F.lit("unknown")), F.lit(" ("), F.col("article_count").cast("string"), F.lit(")"))
    g = e.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("article_count")).alias("o"), "id", line.alias("line")))).alias("l"))
    return g.select("category", F.concat(F.lit("## "), F.initcap("category"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"))


def labelled_lexicon(spark, d):
    """A lexicon fitted from the labels' quality, in which some words turn, raise, lower or oppose, by a hash of theirs."""
    docs = load(spark, d, "documents").select("doc_id", "text").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    h = F.crc32(F.encode("word", "UTF-8")) % 40
    kind = F.when(h == 0, "negation").when(h <= 2, "booster").when(h == 3, "contrast").otherwise("valence")
    return fitted_lexicon(docs, "quality").select("word", kind.alias("kind"), F.when(h == 1, 1.0).when(h == 2, -1.0).otherwise(F.col("value")).alias("value"))


@query("u02_lexicon_sentiment")
def _(spark, d):
    return lexicon_sentiment(load(spark, d, "documents").select("doc_id", "text"), "text", labelled_lexicon(spark, d)).select("doc_id", "sentiment")

"""Sort, limit, top-k, distinct, set operations, and the greedy title filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions.decisions import ranked_models
from ..operators.vectors import merged
from ..registry import query
from ..streaming.state import kept_titles

EV, AR, BA = cte("events"), cte("articles"), cte("bars")


def greedy_titles(articles: DataFrame, by: str, title: str, at: str, order: str, threshold: float = 0.75, memory: int = 2_000, ttl: int = 86_400) -> DataFrame:
    """kept_titles() of a whole table, by one key."""
    return kept_titles(articles, [by], title, at, order, threshold, memory, ttl)


def streaks(rows: DataFrame, by: str, at: str, empty: str) -> DataFrame:
    """Runs of consecutive empty rows per key: (key, first, length)."""
    w = Window.partitionBy(by).orderBy(at)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, empty).orderBy(at))
    return rows.withColumn("_i", island).where(empty).groupBy(by, "_i").agg(F.min(at).alias("first"), F.count("*").alias("length")).drop("_i")


@query("t01_order_limit", "select o_orderkey as id from orders order by o_orderdate desc, o_orderkey desc limit 100")
def _(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select(F.col("o_orderkey").alias("id"))


@query("t02_movers", """(select 'gainers' as list, c_custkey as id, c_acctbal as v from customer order by c_acctbal desc, c_custkey limit 4) union all (select 'losers', c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 4)
union all (select 'active', c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 4)""")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    top = lambda name, *order: c.orderBy(*order, "id").limit(4).select(F.lit(name).alias("list"), "id", "v")
    return top("gainers", F.desc("v")).unionByName(top("losers", "v")).unionByName(top("active", F.desc(F.abs("v"))))


@query("t03_t04_weighted_top_n", cte("articles", "sources") + """, n as (select code, case when weight = 0 then 0 else floor(2 + (greatest(0.1, least(2.0, coalesce(weight, 1.0))) - 0.1) / 1.9 * 4 + 0.5) end as n from sources_)
select a.id from (select *, row_number() over (partition by source_code order by published_s desc, id desc) as r from articles_) a left join n on n.code = a.source_code where r <= coalesce(n.n, 4)""")
def _(spark, d):
    w = F.coalesce("weight", F.lit(1.0))
    n = F.when(w == 0, 0).otherwise(F.floor(2 + (F.greatest(F.lit(0.1), F.least(F.lit(2.0), w)) - 0.1) / 1.9 * 4 + 0.5))
    s = load(spark, d, "sources").select(F.col("code").alias("source_code"), n.alias("n"))
    r = F.row_number().over(Window.partitionBy("source_code").orderBy(F.desc("published_s"), F.desc("id")))
    return load(spark, d, "articles").select("id", "source_code", r.alias("r")).where("r <= 6").join(s, "source_code", "left").where("r <= coalesce(n, 4)").select("id")


@query("t05_t07_markers", EV + " select id, abs(sentiment) as size from events_ where started_at >= timestamp '2024-01-10' and started_at < timestamp '2024-01-20' and sentiment is not null order by abs(sentiment) desc, id limit 40")
def _(spark, d):
    e = load(spark, d, "events").where("started_at >= timestamp '2024-01-10' and started_at < timestamp '2024-01-20' and sentiment is not null")
    return e.select("id", F.abs("sentiment").alias("size")).orderBy(F.desc("size"), "id").limit(40)


@query("t06_top_of_array", "select o_orderkey as id, array_to_string(list_slice(list_reverse_sort([o_orderkey % 7, o_custkey % 11, o_orderkey % 13, o_custkey % 5, 3]), 1, 4)::varchar[], ',') as top from orders")
def _(spark, d):
    a = F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 11, F.col("o_orderkey") % 13, F.col("o_custkey") % 5, F.lit(3).cast("long"))
    top = F.slice(F.sort_array(a, asc=False), 1, 4)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(top, lambda x: x.cast("string")), ",").alias("top"))


@query("t10_ordered_distinct", "select o_orderkey as id, case when o_orderkey % 3 = o_custkey % 3 then (o_orderkey % 3)::varchar || ',z' else (o_orderkey % 3)::varchar || ',z,' || (o_custkey % 3)::varchar end as kept from orders")
def _(spark, d):
    s = lambda c: (F.col(c) % 3).cast("string")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_distinct(F.array(s("o_orderkey"), F.lit("z"), s("o_custkey"), F.lit("z"))), ",").alias("kept"))


@query("t11_dedupe_most_keywords", "select p_brand as slug, arg_max(p_partkey, (p_size, -p_partkey)) as id from part group by 1")
def _(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_brand").alias("slug")).agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("id"))


@query("t12_merge_similar", """with t as (select vec_id as id, label as g, list_distinct(list_transform(range(1, 2 + (vec_id % 4)::int), lambda i: 'k' || (vec_id * i % 23)::varchar)) as kw, ['s' || (vec_id % 3)::varchar] as ids, embedding::double[] as v from embeddings),
l as materialized (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as cos from t a join t b on a.g = b.g where list_cosine_similarity(a.v, b.v) >= 0.85), n as (select a, count(*) as n from l group by a),
c as (select l.a as id, arg_min((l.b, l.cos), (-n.n, l.b)) as x from l join n on n.a = l.b group by l.a), r as (select t.id, coalesce(x[1], t.id) as c, -round(coalesce(x[2], 1.0), 9) as far from t left join c on c.id = t.id),
m as (select r.c, arg_min(t.id, (-len(kw), far, t.id)) as canonical, list_sort(list_distinct(flatten(list(kw)))) as kws, list_sort(list_distinct(flatten(list(ids)))) as sids from t join r using (id) group by 1)
select id, canonical, case when id = canonical then array_to_string(kws, ',') end as keywords, case when id = canonical then array_to_string(sids, ',') end as source_ids from t join r using (id) join m using (c)""")
def _(spark, d):
    v = F.col("vec_id")
    words = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), 1 + v % 4), lambda i: F.concat(F.lit("k"), (v * i % 23).cast("string"))))
    ids = F.array(F.concat(F.lit("s"), (v % 3).cast("string")))
    t = load(spark, d, "embeddings").select(v.alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"), words.alias("keywords"), ids.alias("source_ids"))
    return merged(t).select("id", "canonical", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("keywords", "source_ids")])


@query("t13_greedy_titles")
def _(spark, d):
    return greedy_titles(load(spark, d, "articles").select("id", "source_code", "title", "published_s"), "source_code", "title", "published_s", "id")


@query("t14_t17_set_operations", "select k from (select c_custkey as k from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0) where k % 5 <> 0 and k in (select o_custkey from orders)")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    u = c.where("k % 2 = 0").union(c.where("k % 3 = 0")).distinct()
    return u.exceptAll(c.where("k % 5 = 0")).intersect(load(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("t15_keyword_union", "select o_orderkey as id, array_to_string(list_sort(list_distinct(list_concat(list_transform(string_split(lower(o_orderpriority), '-'), lambda x: trim(x)), ['high', lower(o_orderstatus)]))), ',') as kw from orders")
def _(spark, d):
    kw = F.array_union(F.transform(F.split(F.lower("o_orderpriority"), "-"), lambda x: F.trim(x)), F.array(F.lit("high"), F.lower("o_orderstatus")))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.slice(kw, 1, 25)), ",").alias("kw"))


@query("t18_ranked_models", """select p_name || '#' || p_partkey::varchar as id, p_partkey % 40 * 1000 as context from part where p_partkey % 3 <> 1 and p_partkey % 7 <> 2 and p_partkey % 40 * 1000 >= 16000 and not contains(lower(p_name || '#' || p_partkey::varchar), '#1') order by context desc, id limit 12""")
def _(spark, d):
    k = F.col("p_partkey")
    m = load(spark, d, "part").select(F.concat("p_name", F.lit("#"), k.cast("string")).alias("id"), F.when(k % 3 == 1, 0.5).when(k % 3 == 2, 0.0).alias("prompt_price"), F.lit(None).cast("double").alias("completion_price"), F.when(k % 7 == 2, "image").when(k % 7 == 3, "text+image").alias("modalities"), (k % 40 * 1000).alias("context"))
    return ranked_models(m, ("#1",)).limit(12).select("id", "context")


@query("t20_ranked_page", "select p_partkey as id, (select count(*) from part where p_size >= 16) as total from part where p_size >= 16 order by p_retailprice desc, p_partkey limit 12")
def _(spark, d):
    p = load(spark, d, "part").where("p_size >= 16")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(12).select(F.col("p_partkey").alias("id")).crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))  # one row


@query("t22_stratified_sample", AR + " select id from (select id, source_code, row_number() over (partition by source_code order by id * 7919 % 1009, id) as r from articles_) where r <= 5 order by source_code, id limit 60")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("source_code").orderBy(F.col("id") * 7919 % 1009, "id"))
    return load(spark, d, "articles").select("id", "source_code", r.alias("r")).where("r <= 5").orderBy("source_code", "id").limit(60).select("id")


@query("w21_empty_streaks", BA + """, s as (select *, volume is null as e, row_number() over (partition by symbol order by d) - row_number() over (partition by symbol, volume is null order by d) as i from bars_)
select symbol, min(d) as first, count(*) as length from s where e group by symbol, i having count(*) >= 2""")
def _(spark, d):
    return streaks(load(spark, d, "bars").withColumn("e", F.col("volume").isNull()), "symbol", "d", "e").where("length >= 2")

"""Grouped analytics: event aggregation, topic statistics, accuracies, censuses, pressures, map clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import routing as R
from ..functions.numbers import places
from ..operators.ranks import exact_quantiles, ordinal_ranks
from ..registry import query

EV, AR, FC = cte("events"), cte("articles"), cte("forecasts")
GRID_DAYS = 3


def grid(epoch_s):
    """Start, in days since 1970, of the three-day cell that holds a time in seconds."""
    return F.floor(epoch_s / (GRID_DAYS * 86400)) * GRID_DAYS


def aggregate_events(articles: DataFrame, min_articles: int = 1) -> DataFrame:
    """Events of articles (id, source_code, title, published_s, city, country, category, sentiment, finbert, intensity,
    latitude, longitude, cluster).

    A bucket is (city, country, category or general, three-day cell) and a cluster divides it. Counts and means are
    combined before the shuffle; the representative is the article of the largest intensity (null: 0), the smallest id
    among equals. Intensity grows with corroboration: 0.3 times a tenth of the articles, up to 1. Articles without a place
    take no part. Ids and sources come back sorted. Means have 4 places, the intensity's mean before it grows too, and the
    centroid 6."""
    a = articles.where("city is not null and country is not null").select("*", F.coalesce("category", F.lit("general")).alias("cat"), grid(F.col("published_s")).alias("cell"))
    keys = ["city", "country", "cat", "cell", "cluster"]
    g = a.groupBy(*keys).agg(
        F.count("*").alias("article_count"), places(F.avg("sentiment"), 4).alias("avg_sentiment"), places(F.avg("finbert"), 4).alias("avg_finbert"), places(F.avg("intensity"), 4).alias("mean_intensity"),
        places(F.avg("latitude"), 6).alias("latitude"), places(F.avg("longitude"), 6).alias("longitude"),
        F.min("published_s").alias("started_s"), F.max("published_s").alias("last_s"),
        F.max_by(F.struct("id", "title"), F.struct(F.coalesce("intensity", F.lit(0.0)), -F.col("id"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set("source_code")), ",").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("article_ids"),
    )
    lifted = places(F.least(F.col("mean_intensity") + F.least(F.col("article_count") / 10, F.lit(1.0)) * 0.3, F.lit(1.0)), 4)
    g = g.where(F.col("article_count") >= min_articles).withColumn("intensity", lifted)
    return g.withColumns({"representative": F.col("best.id"), "title": F.col("best.title")}).drop("best")


@query("a01_a06_event_aggregation", AR + """, g as (select city, country, coalesce(category, 'general') as cat, floor(published_s / 259200)::bigint * 3 as cell, cluster, count(*) as article_count, round_even(avg(sentiment), 4) as avg_sentiment, round_even(avg(finbert), 4) as avg_finbert, round_even(avg(intensity), 4) as mean_intensity, round_even(avg(latitude), 6) as latitude, round_even(avg(longitude), 6) as longitude, arg_max(title, (coalesce(intensity, 0), -id)) as title,
  min(published_s) as started_s, max(published_s) as last_s, arg_max(id, (coalesce(intensity, 0), -id)) as representative, string_agg(distinct source_code, ',' order by source_code) as sources, string_agg(id::varchar, ',' order by id) as article_ids
  from articles_ where city is not null and country is not null group by 1, 2, 3, 4, 5)
select *, round_even(least(mean_intensity + least(article_count / 10, 1) * 0.3, 1), 4) as intensity from g where article_count >= 1""")
def event_aggregation(spark, d):
    return aggregate_events(load(spark, d, "articles"))


@query("a05_usage_rollup", "select coalesce(o_orderpriority, 'total') as provider, count(*) as calls, sum(o_custkey)::bigint as tokens from orders group by rollup(o_orderpriority)")
def _(spark, d):
    return load(spark, d, "orders").rollup("o_orderpriority").agg(F.count("*").alias("calls"), F.sum("o_custkey").alias("tokens")).select(F.coalesce("o_orderpriority", F.lit("total")).alias("provider"), "calls", "tokens")


NOW = "timestamp '2024-01-30 00:00:00'"


@query("a07_a08_topic_stats", EV + f""", t as (select unnest(string_split(topics, ',')) as slug, * from events_ where topics <> '' and started_at >= {NOW} - interval 7 days and started_at <= {NOW})
select slug, count(*) as events_7d, coalesce(sum(article_count) filter (where started_at >= {NOW} - interval 24 hours), 0)::bigint as articles_24h, round_even(avg(intensity), 4) as avg_intensity,
 epoch(max(started_at))::bigint as latest_s, round_even(coalesce(sum(article_count) filter (where started_at >= {NOW} - interval 24 hours), 0) * (1 + coalesce(round_even(avg(intensity), 4), 0))
 * case when epoch({NOW} - max(started_at)) <= 86400 then 1.0 when epoch({NOW} - max(started_at)) <= 259200 then 0.6 when epoch({NOW} - max(started_at)) <= 604800 then 0.2 else 0.05 end, 4) as score from t group by slug""")
def _(spark, d):
    now = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    e = load(spark, d, "events").where("topics <> ''").where((F.col("started_at") >= now - F.expr("interval 7 days")) & (F.col("started_at") <= now))
    recent = F.when(F.col("started_at") >= now - F.expr("interval 24 hours"), F.col("article_count"))
    g = e.select("*", F.explode(F.split("topics", ",")).alias("slug")).groupBy("slug").agg(F.count("*").alias("events_7d"), F.coalesce(F.sum(recent), F.lit(0)).alias("articles_24h"), places(F.avg("intensity"), 4).alias("avg_intensity"), F.max("started_at").alias("m"))
    age = (F.unix_micros(now) - F.unix_micros("m")) / 1e6
    recency = F.when(age <= 86400, 1.0).when(age <= 259200, 0.6).when(age <= 604800, 0.2).otherwise(0.05)
    return g.select("slug", "events_7d", "articles_24h", "avg_intensity", F.round(F.unix_micros("m") / 1e6).cast("long").alias("latest_s"), places(F.col("articles_24h") * (1 + F.coalesce("avg_intensity", F.lit(0.0))) * recency, 4).alias("score"))


@query("a09_discovery_buckets", EV + """, b as (select category, trim(string_split(location_name, ',')[-1]) as place, count(*) as n from events_ where topics = '' and location_name is not null group by 1, 2 having count(*) >= 3)
select * from b order by n desc, category, place limit 5""")
def _(spark, d):
    e = load(spark, d, "events").where("topics = '' and location_name is not null")
    g = e.groupBy("category", F.trim(F.element_at(F.split("location_name", ","), -1)).alias("place")).agg(F.count("*").alias("n")).where("n >= 3")
    return g.orderBy(F.desc("n"), "category", "place").limit(5)


@query("a10_fresh_slugs", EV + """, f as (select distinct unnest(string_split(topics, ',')) as slug from events_ where started_at >= timestamp '2024-01-25')
select slug, slug in (select slug from f) as fresh from (select distinct unnest(string_split(topics, ',')) as slug from events_) where slug <> ''""")
def _(spark, d):
    e = load(spark, d, "events").select("started_at", F.explode(F.split("topics", ",")).alias("slug")).where("slug <> ''")
    return e.groupBy("slug").agg(F.coalesce(F.max(F.col("started_at") >= "2024-01-25"), F.lit(False)).alias("fresh"))


@query("a11_source_yield", cte("articles", "sources") + """, y as (select source_code, count(*) as total, count(*) filter (where stage = 'processed') as used from articles_ group by 1)
select s.code, coalesce(y.total, 0) as total, case when s.weight_locked or coalesce(total, 0) < 10 then s.weight when used / total >= 0.66 then least(weight + 0.125, 2.0) when used / total < 0.65 then greatest(weight - 0.125, 0.5) else weight end::double as weight from sources_ s left join y on y.source_code = s.code""")
def _(spark, d):
    y = load(spark, d, "articles").groupBy("source_code").agg(F.count("*").alias("total"), F.count_if(F.col("stage") == "processed").alias("used"))
    s = load(spark, d, "sources").join(y, F.col("code") == F.col("source_code"), "left")
    rate = F.col("used") / F.col("total")
    nudged = F.when(rate >= 0.66, F.least(F.col("weight") + 0.125, F.lit(2.0))).when(rate < 0.65, F.greatest(F.col("weight") - 0.125, F.lit(0.5))).otherwise(F.col("weight"))
    return s.select("code", F.coalesce("total", F.lit(0)).alias("total"), F.when(F.col("weight_locked") | (F.coalesce("total", F.lit(0)) < 10), F.col("weight")).otherwise(nudged).alias("weight"))


@query("a12_a14_accuracy", FC + """ select horizon_days, count(*) as n, avg(case when (direction_prob > 0.5) = (realized_return > 0) then 1 else 0 end) as accuracy, avg((direction_prob - case when realized_return > 0 then 1 else 0 end) ** 2) as brier
 from forecasts_ where realized_return is not null group by rollup(horizon_days)""")
def _(spark, d):
    up = F.when(F.col("realized_return") > 0, 1).otherwise(0)
    right = F.when((F.col("direction_prob") > 0.5) == (F.col("realized_return") > 0), 1).otherwise(0)
    return load(spark, d, "forecasts").where("realized_return is not null").rollup("horizon_days").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(F.pow(F.col("direction_prob") - up, 2)).alias("brier"))


@query("a13_weekly_accuracy", FC + """ select date_trunc('week', generated_at)::date as week, count(*) as n, avg(case when (direction_prob > 0.5) = (realized_return > 0) then 1 else 0 end) as accuracy from forecasts_ where realized_return is not null group by 1""")
def _(spark, d):
    right = F.when((F.col("direction_prob") > 0.5) == (F.col("realized_return") > 0), 1).otherwise(0)
    return load(spark, d, "forecasts").where("realized_return is not null").groupBy(F.date_trunc("week", "generated_at").cast("date").alias("week")).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


@query("a15_census", AR + """ select case when is_deleted then 'deleted' when stage = 'processed' then 'done' when stage = 'fetched' then 'waiting' else stage end as state, count(*) as n, count(*) * 100 / sum(count(*)) over () as pct from articles_ group by 1""")
def _(spark, d):
    state = F.when(F.col("is_deleted"), "deleted").when(F.col("stage") == "processed", "done").when(F.col("stage") == "fetched", "waiting").otherwise(F.col("stage"))
    g = load(spark, d, "articles").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("state", "n", (F.col("n") * 100 / F.col("total")).alias("pct"))  # one row, five states


@query("a16_a17_monthly_activity", """with m as (select unnest(generate_series(date '1995-01-01', date '2001-12-01', interval 1 month))::date as month),
o as (select date_trunc('month', o_orderdate)::date as month, o_orderstatus, count(*) as n from orders group by 1, 2)
select m.month, coalesce(sum(n) filter (where o_orderstatus = 'F'), 0)::bigint as f, coalesce(sum(n) filter (where o_orderstatus = 'O'), 0)::bigint as o, coalesce(sum(n) filter (where o_orderstatus = 'P'), 0)::bigint as p from m left join o on o.month = m.month group by 1""")
def _(spark, d):
    months = spark.sql("select explode(sequence(date '1995-01-01', date '2001-12-01', interval 1 month)) as month")
    g = load(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return months.join(g, "month", "left").select("month", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


@query("a18_stacked_series", """select date_trunc('year', o_orderdate)::date as y, o_orderpriority as series, count(*) as n, sum(count(*)) over (partition by date_trunc('year', o_orderdate)::date order by o_orderpriority)::bigint as stacked from orders group by 1, 2""")
def _(spark, d):
    g = load(spark, d, "orders").groupBy(F.trunc("o_orderdate", "year").alias("y"), F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("n"))
    return g.withColumn("stacked", F.sum("n").over(Window.partitionBy("y").orderBy("series")))


@query("a19_age_buckets", EV + """, a as (select category, epoch(timestamp '2024-01-31' - started_at) as s from events_)
select category, count(*) filter (where s < 3600) as h1, count(*) filter (where s >= 3600 and s < 86400) as d1, count(*) filter (where s >= 86400 and s < 604800) as w1, count(*) filter (where s >= 604800) as older from a group by 1""")
def _(spark, d):
    s = (F.unix_micros(F.to_timestamp(F.lit("2024-01-31"))) - F.unix_micros("started_at")) / 1e6
    return load(spark, d, "events").groupBy("category").agg(F.count_if(s < 3600).alias("h1"), F.count_if((s >= 3600) & (s < 86400)).alias("d1"), F.count_if((s >= 86400) & (s < 604800)).alias("w1"), F.count_if(s >= 604800).alias("older"))


@query("a20_stage_coverage", AR + """ select stage, count(*) as n, count(*) filter (where intensity is null) as failed, min(id) filter (where intensity is null) as sample from articles_ group by 1""")
def _(spark, d):
    return load(spark, d, "articles").groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("intensity").isNull()).alias("failed"), F.min(F.when(F.col("intensity").isNull(), F.col("id"))).alias("sample"))


@query("a21_a24_health", """select event_type as provider, max(ts) >= timestamp '2024-01-29' as fresh, count(*) filter (where value > 0) as ok, count(*) filter (where not value > 0) as err, (sum(user_id) // count(*))::bigint as avg_ms from events group by 1""")
def _(spark, d):
    ok = F.count_if(F.col("value") > 0)
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("provider")).agg(
        (F.max("ts") >= F.to_timestamp(F.lit("2024-01-29"))).alias("fresh"), ok.alias("ok"), F.count_if(~(F.col("value") > 0)).alias("err"), F.expr("sum(user_id) div count(*)").alias("avg_ms"))


@query("a25_latency_percentiles", """select l_returnflag as k, quantile_cont(l_quantity, 0.5) as p50, quantile_cont(l_quantity, 0.95) as p95, quantile_cont(l_quantity, 0.99) as p99, avg(l_quantity) as mean from lineitem group by 1""")
def _(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity")
    q = exact_quantiles(rows, "k", "l_quantity", [0.5, 0.95, 0.99]).select(F.col("k").alias("_k"), F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99"))
    means = rows.groupBy("k").agg(F.avg("l_quantity").alias("mean"))
    return means.join(q, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")


def metrics(df: DataFrame, by: list[str], y: str, p: str, pred: str) -> DataFrame:
    """n, accuracy, macro F1, ROC-AUC (null if one class) and Brier score per group. The AUC comes of ranks of distinct
    probabilities: groups are summed per probability before any window, so a group may have any number of rows."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    steps = df.groupBy(*by, p).agg(pos.alias("a"), neg.alias("b"))
    below = F.sum("b").over(Window.partitionBy(*by).orderBy(p)) - F.col("b")
    auc = steps.withColumn("u", F.col("a") * (below + F.col("b") / 2)).groupBy(*by).agg((F.sum("u") / F.nullif(F.sum("a") * F.sum("b"), F.lit(0))).alias("roc_auc"))
    c = lambda t, q: F.count_if((F.col(y) == t) & (F.col(pred) == q))
    g = df.groupBy(*by).agg(F.count("*").alias("n"), c(1, 1).alias("tp"), c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    f1 = lambda hit: F.coalesce(2 * F.col(hit) / F.nullif(2 * F.col(hit) + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return g.join(auc, by).select(*by, "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((f1("tp") + f1("tn")) / 2).alias("f1_macro"), "roc_auc", "brier")


@query("a26_forecast_metrics", FC + """, f as (select symbol, direction_prob as p, (realized_return > 0)::int as y, (direction_prob > 0.5)::int as q from forecasts_ where realized_return is not null),
s as (select symbol, p, sum(y) as a, sum(1 - y) as b from f group by 1, 2), u as (select symbol, sum(a * (below + b / 2)) / nullif(sum(a) * sum(b), 0) as roc_auc from (select *, sum(b) over (partition by symbol order by p) - b as below from s) group by 1),
g as (select symbol, count(*) as n, sum(y * q) as tp, sum((1 - y) * (1 - q)) as tn, sum((1 - y) * q) as fp, sum(y * (1 - q)) as fn, avg((p - y) ** 2) as brier from f group by 1)
select symbol, n, (tp + tn) / n as accuracy, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 as f1_macro, roc_auc::double as roc_auc, brier from g join u using (symbol)""")
def _(spark, d):
    f = load(spark, d, "forecasts").where("realized_return is not null").select("symbol", F.col("direction_prob").alias("p"), (F.col("realized_return") > 0).cast("int").alias("y"), (F.col("direction_prob") > 0.5).cast("int").alias("q"))
    return metrics(f, ["symbol"], "y", "p", "q")


@query("a27_reliability", FC + """ select least(floor(direction_prob * 10)::int, 9) as bin, avg(direction_prob) as pred_mean, avg((realized_return > 0)::int) as emp_freq, count(*) as n from forecasts_ where realized_return is not null group by 1""")
def _(spark, d):
    b = F.least(F.greatest(F.floor(F.col("direction_prob") * 10), F.lit(0)), F.lit(9)).cast("int")
    return load(spark, d, "forecasts").where("realized_return is not null").groupBy(b.alias("bin")).agg(F.avg("direction_prob").alias("pred_mean"), F.avg((F.col("realized_return") > 0).cast("int")).alias("emp_freq"), F.count("*").alias("n"))


def coverage(landmarks: DataFrame) -> DataFrame:
    """One row: how many landmarks (n_articles, n_events, max_importance, n_routed, max_abs_move) there are, and the share
    of them with articles, events, an importance, routed events and a move, to 3 places; shares of nothing are 0."""
    share = lambda c, name: places(F.coalesce(F.avg(F.when(c, 1).otherwise(0)), F.lit(0.0)), 3).alias(name)
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return landmarks.agg(
        F.count("*").alias("landmarks"), share(some("n_articles"), "with_articles"), share(some("n_events"), "with_events"), share(F.col("max_importance").isNotNull(), "with_importance"),
        share(some("n_routed"), "with_routed"), share(F.col("max_abs_move").isNotNull(), "with_price_move"),
    )


def discrimination(days: DataFrame, is_landmark: str) -> DataFrame:
    """One row: means of intensity, importance and move over landmark days and over others, to 4 places."""
    mean = lambda c, landmark, name: places(F.avg(F.when(F.col(is_landmark) == landmark, F.col(c))), 4).alias(name)
    return days.agg(*[mean(c, of, f"{name}_{kind}") for c, name in (("max_intensity", "intensity"), ("max_importance", "importance"), ("max_abs_move", "move")) for of, kind in ((True, "landmark"), (False, "random"))])


MARKED = EV + """, l as (select started_at::date as day, location_name, day(started_at) % 3 = 0 as is_landmark, count(*) filter (where intensity > 0.9) as n_articles, count(*) filter (where category = 'conflict') as n_events, max(intensity * 10) filter (where id % 4 = 0) as max_importance,
 count(*) filter (where topics <> '' and intensity > 0.8) as n_routed, max(abs(sentiment)) filter (where id % 16 = 1) as max_abs_move, max(intensity) as max_intensity from events_ where location_name is not null group by 1, 2, 3)"""


def _marked(spark, d) -> DataFrame:
    e = load(spark, d, "events").where("location_name is not null")
    return e.groupBy(F.to_date("started_at").alias("day"), "location_name", (F.dayofmonth("started_at") % 3 == 0).alias("is_landmark")).agg(
        F.count_if(F.col("intensity") > 0.9).alias("n_articles"), F.count_if(F.col("category") == "conflict").alias("n_events"), F.max(F.when(F.col("id") % 4 == 0, F.col("intensity") * 10)).alias("max_importance"),
        F.count_if((F.col("topics") != "") & (F.col("intensity") > 0.8)).alias("n_routed"), F.max(F.when(F.col("id") % 16 == 1, F.abs("sentiment"))).alias("max_abs_move"), F.max("intensity").alias("max_intensity"),
    )


@query("a30_coverage", MARKED + """ select count(*) as landmarks, round_even(avg((n_articles > 0)::int), 3) as with_articles, round_even(avg((n_events > 0)::int), 3) as with_events, round_even(avg((max_importance is not null)::int), 3) as with_importance, round_even(avg((n_routed > 0)::int), 3) as with_routed, round_even(avg((max_abs_move is not null)::int), 3) as with_price_move from l where is_landmark""")
def _(spark, d):
    return coverage(_marked(spark, d).where("is_landmark"))


@query("a30_discrimination", MARKED + " select " + ", ".join(f"round_even(avg({c}) filter (where is_landmark = {of}), 4) as {name}_{kind}" for c, name in (("max_intensity", "intensity"), ("max_importance", "importance"), ("max_abs_move", "move")) for of, kind in (("true", "landmark"), ("false", "random"))) + " from l")
def _(spark, d):
    return discrimination(_marked(spark, d), "is_landmark")


@query("a32_a47_hit_rate", EV + """ select category, avg(case when location_name is null then 0 else 1 end) as located, avg(case when (sentiment >= 0) = (finbert >= 0) then 1 else 0 end) filter (where sentiment is not null and finbert is not null) as hit_rate from events_ group by 1""")
def _(spark, d):
    both = F.col("sentiment").isNotNull() & F.col("finbert").isNotNull()
    hit = F.when(both, F.when((F.col("sentiment") >= 0) == (F.col("finbert") >= 0), 1).otherwise(0))
    return load(spark, d, "events").groupBy("category").agg(F.avg(F.when(F.col("location_name").isNull(), 0).otherwise(1)).alias("located"), F.avg(hit).alias("hit_rate"))


@query("a31_spearman_ordinal", EV + """, r as (select category, row_number() over (partition by category order by sentiment, id) as a, row_number() over (partition by category order by intensity, id) as b from events_ where sentiment is not null and intensity is not null)
select category, count(*) as n, 1 - 6 * sum((a - b) * (a - b)) / (count(*)::double * (count(*) * count(*) - 1)) as rho from r group by 1 having count(*) >= 4""")
def _(spark, d):
    e = load(spark, d, "events").where("sentiment is not null and intensity is not null")
    e = e.select("category", "id", "sentiment", "intensity")
    r = ordinal_ranks(ordinal_ranks(e, "category", ["sentiment", "id"], "a"), "category", ["intensity", "id"], "b").select("category", (F.col("a") - F.col("b")).alias("x"))
    g = r.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long") * F.col("x")).alias("s")).where("n >= 4")
    return g.select("category", "n", (1 - 6 * F.col("s") / (F.col("n").cast("double") * (F.col("n") * F.col("n") - 1))).alias("rho"))


@query("a33_digest_day", EV + """, e as (select *, case category when 'conflict' then 1 when 'political' then 2 when 'economic' then 3 when 'disaster' then 4 end as place from events_ where started_at >= timestamp '2024-01-10' and started_at < timestamp '2024-01-10 23:59:59.999999')
select place::int as place, category, count(*) as n, sum(article_count)::bigint as articles, arg_max(id, (coalesce(intensity, 0), -id)) as cover from e where place is not null group by 1, 2""")
def _(spark, d):
    e = load(spark, d, "events").where("started_at >= timestamp '2024-01-10' and started_at < timestamp '2024-01-10 23:59:59.999999'")
    place = R.lookup({"conflict": 1, "political": 2, "economic": 3, "disaster": 4}, F.col("category"))
    g = e.withColumn("place", place).where("place is not null").groupBy("place", "category")
    return g.agg(F.count("*").alias("n"), F.sum("article_count").alias("articles"), F.max_by("id", F.struct(F.coalesce("intensity", F.lit(0.0)), -F.col("id"))).alias("cover"))


@query("a34_a35_pressure_summary", EV + """, p as (select category as symbol, id, sentiment * exp(-greatest(0, epoch(timestamp '2024-01-31' - started_at) / 86400) / 3) as w from events_ where sentiment is not null and started_at >= timestamp '2024-01-20'),
t as (select *, row_number() over (partition by symbol order by abs(w) desc, id) as r from p)
select symbol, round(sum(w), 6) as net, count(*) filter (where w > 0) as up, count(*) filter (where w < 0) as down, string_agg(id::varchar, ',' order by r) filter (where r <= 3) as top from t group by 1""")
def _(spark, d):
    age = (F.unix_micros(F.to_timestamp(F.lit("2024-01-31"))) - F.unix_micros("started_at")) / 1e6 / 86400
    p = load(spark, d, "events").where("sentiment is not null and started_at >= timestamp '2024-01-20'").select(F.col("category").alias("symbol"), "id", (F.col("sentiment") * F.exp(-F.greatest(F.lit(0.0), age) / 3)).alias("w"))
    best = p.select("*", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("w")), "id")).alias("r")).where("r <= 3")
    top = best.groupBy("symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("top"))
    g = p.groupBy("symbol").agg(F.round(F.sum("w"), 6).alias("net"), F.count_if(F.col("w") > 0).alias("up"), F.count_if(F.col("w") < 0).alias("down"))
    return g.join(top, "symbol")


@query("a36_a43_daily_pressure", EV + """ select started_at::date as day, category as symbol, sum(sentiment) as net, count(*) as n, avg(finbert) as finbert from events_ group by 1, 2""")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("started_at").alias("day"), F.col("category").alias("symbol")).agg(F.sum("sentiment").alias("net"), F.count("*").alias("n"), F.avg("finbert").alias("finbert"))


def strong_edges(edges: DataFrame, most_causes: int = 8, share: float = 0.08) -> DataFrame:
    """Edges (cause, symbol, net) of the 8 causes with the largest sums of absolute weights, that have 8 % of the largest
    edge of all or more. The two small tables, of one row and of 8, are broadcast."""
    most = edges.agg(F.max(F.abs("net")).alias("most"))
    top = edges.groupBy("cause").agg(F.sum(F.abs("net")).alias("total")).orderBy(F.desc("total"), "cause").limit(most_causes).select("cause")
    return edges.join(F.broadcast(top), "cause").join(F.broadcast(most), F.abs("net") >= share * F.col("most")).select("cause", "symbol", "net")


@query("a37_a38_cause_effect", EV + """, c as (select unnest(list_concat([category, location_name], list_filter(string_split(topics, ','), lambda x: x <> ''))) as cause, sub_category as symbol, sentiment as w from events_ where sentiment is not null),
g as (select cause, symbol, sum(w) as net from c where cause is not null group by 1, 2), t as (select cause from g group by 1 order by sum(abs(net)) desc, cause limit 8) select * from g where cause in (select cause from t) and abs(net) >= 0.08 * (select max(abs(net)) from g)""")
def _(spark, d):
    causes = F.concat(F.array("category", "location_name"), F.filter(F.split("topics", ","), lambda x: x != ""))
    g = load(spark, d, "events").where("sentiment is not null").select(F.explode(causes).alias("cause"), F.col("sub_category").alias("symbol"), F.col("sentiment").alias("w")).where("cause is not null")
    return strong_edges(g.groupBy("cause", "symbol").agg(F.sum("w").alias("net")))


@query("a39_pressure_gauge", EV + """, g as (select started_at::date as day, sum(abs(sentiment)) as pressure from events_ group by 1), r as (select *, cume_dist() over (order by pressure) as share from g)
select day, pressure, share, case when share >= 0.92 then 3 when share >= 0.75 then 2 when share >= 0.25 then 1 else 0 end as level from r""")
def _(spark, d):
    g = load(spark, d, "events").groupBy(F.to_date("started_at").alias("day")).agg(F.sum(F.abs("sentiment")).alias("pressure"))
    r = g.withColumn("share", F.cume_dist().over(Window.orderBy("pressure")))  # a row per day
    return r.withColumn("level", F.when(F.col("share") >= 0.92, 3).when(F.col("share") >= 0.75, 2).when(F.col("share") >= 0.25, 1).otherwise(0))


#: Decimals by which the map's five zooms round.
ZOOM_DECIMALS = (0, 1, 2, 3, 10)


@query("a41_a42_map_clusters", EV + """, z as (select unnest([0, 1, 2, 3, 10]) as decimals), p as (select decimals, floor(latitude * 10::double ** decimals + 0.5)::bigint as y, floor(longitude * 10::double ** decimals + 0.5)::bigint as x, latitude, longitude, category, id from events_, z where latitude is not null and longitude is not null),
g as (select decimals, y, x, category, count(*) as n, sum(latitude) as la, sum(longitude) as lo, min(id) as fst from p group by all)
select decimals, y, x, sum(n)::bigint as n, sum(la) / sum(n) as lat, sum(lo) / sum(n) as lon, arg_max(category, (n, -fst)) as dominant, least(52, 30 + log2(sum(n) + 1) * 5)::double as size from g group by all""")
def _(spark, d):
    e = load(spark, d, "events").select("id", "latitude", "longitude", "category", F.explode(F.array(*map(F.lit, ZOOM_DECIMALS))).alias("decimals"))
    return map_clusters(e)


def map_clusters(points: DataFrame) -> DataFrame:
    """Markers of points (id, latitude, longitude, category, decimals): one per cell of coordinates rounded half up to so many
    decimals (points without both are left out), at the mean of its points, with their number, the category of most of them (of equal ones that of the first
    id) and the marker's size in pixels."""
    cell = lambda c: F.floor(F.col(c) * F.pow(F.lit(10.0), "decimals") + 0.5)
    g = points.where("latitude is not null and longitude is not null").groupBy("decimals", cell("latitude").alias("y"), cell("longitude").alias("x"), "category").agg(F.count("*").alias("n"), F.sum("latitude").alias("la"), F.sum("longitude").alias("lo"), F.min("id").alias("first"))
    c = g.groupBy("decimals", "y", "x").agg(F.sum("n").alias("n"), (F.sum("la") / F.sum("n")).alias("lat"), (F.sum("lo") / F.sum("n")).alias("lon"), F.max_by("category", F.struct("n", -F.col("first"))).alias("dominant"))
    return c.withColumn("size", F.least(F.lit(52.0), 30 + F.log2(F.col("n") + 1) * 5))


@query("a44_grouped_symbols", "select p_brand as grp, string_agg(p_name, ',' order by p_partkey) as symbols from part group by 1")
def _(spark, d):
    g = load(spark, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("s"))
    return g.select("grp", F.array_join(F.transform("s", lambda x: x["p_name"]), ",").alias("symbols"))


@query("a45_a49_max_and_count", cte("bars") + " select symbol, max(d) as last, count(*) as n, count(*) > 0 as present from bars_ group by 1")
def _(spark, d):
    return load(spark, d, "bars").groupBy("symbol").agg(F.max("d").alias("last"), F.count("*").alias("n"), (F.count("*") > 0).alias("present"))


@query("a46_source_day_tally", AR + """ select source_code, published_s // 86400 as day, count(*) as fetched, count(*) filter (where is_deleted is distinct from true) as saved from articles_ group by 1, 2""")
def _(spark, d):
    return load(spark, d, "articles").groupBy("source_code", F.expr("published_s div 86400").alias("day")).agg(F.count("*").alias("fetched"), F.count_if(~F.col("is_deleted").eqNullSafe(True)).alias("saved"))


def gold_misses(gold: DataFrame, predicted: DataFrame, key: str, most_chars: int = 50) -> DataFrame:
    """(key, got, expected, title, right, accuracy): gold (key, expected, title) against predicted (key, got); a row without
    a prediction is a miss; accuracy is of the whole set."""
    met = gold.join(predicted, key, "left").withColumn("right", F.coalesce(F.col("got") == F.col("expected"), F.lit(False)))
    total = met.agg(F.avg(F.col("right").cast("int")).alias("accuracy"))  # one row
    return met.crossJoin(F.broadcast(total)).select(key, "got", "expected", F.substring("title", 1, most_chars).alias("title"), "right", "accuracy")


@query("a48_gold_misses", AR + """, g as (select a.id, case when l.toxic = 1 then 'conflict' else 'economic' end as expected, a.title from labels l join articles_ a on a.id = l.doc_id), p as (select id, category as got from articles_ where category is not null), m as (select g.*, p.got, coalesce(p.got = g.expected, false) as ok from g left join p using (id))
select id, got, expected, title[1:50] as title, (select avg(ok::int) from m) as accuracy from m where not ok""")
def _(spark, d):
    a = load(spark, d, "articles")
    gold = load(spark, d, "labels").join(a.select("id", "title"), F.col("doc_id") == F.col("id")).select("id", F.when(F.col("toxic") == 1, "conflict").otherwise("economic").alias("expected"), "title")
    return gold_misses(gold, a.where("category is not null").select("id", F.col("category").alias("got")), "id").where("not right").drop("right")


@query("a50_label_drift", "select l.quality, l.toxic, count(*) as n, count(*) filter (where d.n_chars % 2 <> l.quality) as drift from labels l join documents d using (doc_id) group by 1, 2")
def _(spark, d):
    j = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") % 2 != F.col("quality")).alias("drift"))

"""Streaming operators as queries: a stream over the table's files, read once, must equal its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..registry import query
from ..streaming import windows as W
from ..streaming.state import gated_sources, kept_titles

EV = cte("events")


def _folder(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/stream-{name}-{uuid.uuid4().hex}"


def _stream(spark, d):
    """The events table as a stream of files."""
    path = f"{d}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return s.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("started_at"), "user_id", "event_type", "value", (1 + F.col("event_id") % 9).alias("article_count"))


@query("r03_r05_tumbling_windows", "select floor(epoch(ts) / 259200)::bigint * 259200 as start_s, event_type, count(*) as n, sum(1 + event_id % 9)::bigint as articles, floor(max(epoch(ts)))::bigint as last_s from events group by 1, 2")
def _(spark, d):
    w = W.event_windows(_stream(spark, d), "started_at", ["event_type"])
    return W.run(w, _folder(spark, "windows"), "update", ["start_s", "event_type"])


@query("r03_closed_windows", "select * from (select floor(epoch(ts) / 259200)::bigint * 259200 as start_s, event_type, count(*) as n, sum(1 + event_id % 9)::bigint as articles, floor(max(epoch(ts)))::bigint as last_s from events group by 1, 2) where start_s + 259200 <= (select floor(max(epoch(ts)) * 1000) / 1000 - 7 * 86400 from events)")
def _(spark, d):
    return W.run(W.event_windows(_stream(spark, d), "started_at", ["event_type"]), _folder(spark, "closed"))


@query("r06_first_seen", "select user_id, event_type, true as seen from events group by 1, 2")
def _(spark, d):
    s = W.first_seen(_stream(spark, d), ["user_id", "event_type"], "started_at", "60 days")
    return W.run(s, _folder(spark, "seen")).select("user_id", "event_type", F.lit(True).alias("seen"))


@query("r06_kept_titles")
def _(spark, d):
    """The titles of articles by source, as a stream of files; equal to t13_greedy_titles."""
    path = f"{d}/documents.parquet"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    titles = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_code"), F.substring("text", 1, 60).alias("title"), (1704067200 + F.col("doc_id") * 1200).alias("published_s"))
    titles = titles.withColumn("published_at", F.timestamp_seconds("published_s"))
    return W.run(kept_titles(titles, ["source_code"], "title", "published_s", "id", event_time="published_at"), _folder(spark, "titles")).drop("published_at")


def fetches(events: DataFrame) -> DataFrame:
    """Events as fetches of 20 sources: errors time out, clicks find something, signups fail otherwise, others nothing."""
    outcome = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "signup", "failed").otherwise("empty")
    return events.select("id", (F.col("user_id") % 20).alias("source"), outcome.alias("outcome"), F.unix_timestamp("started_at").alias("at"), "started_at")


@query("r07_source_gate")
def _(spark, d):
    gated = gated_sources(fetches(_stream(spark, d)), ["source"], "outcome", "at", "id", event_time="started_at")
    return W.run(gated, _folder(spark, "gate")).drop("started_at")


@query("r08_checkpoint", "select distinct user_id as source, ts::date as day from events where not (user_id % 2 = 0 and day(ts) % 3 = 0)")
def _(spark, d):
    days = load(spark, d, "events").select(F.col("user_id").alias("source"), F.to_date("started_at").alias("day")).distinct()
    done = days.where("source % 2 = 0 and day(day) % 3 = 0")
    return days.join(done, ["source", "day"], "left_anti")


@query("r12_batch_summary", "select count(*) as n, max(value) as strongest from events")
def _(spark, d):
    return W.summary(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("value", "magnitude"))


@query("r15_retag", EV + " select id, case when topics like '%inflation%' then 2 when topics <> '' then 1 else 0 end + case when category = 'health' then 1 else 0 end as n_topics from events_")
def _(spark, d):
    e = load(spark, d, "events")
    old = F.map_from_entries(F.transform(F.filter(F.split("topics", ","), lambda x: x != ""), lambda x: F.struct(x, F.lit(1.0))))
    new = F.when(F.col("category") == "health", F.create_map(F.lit("public-health"), F.lit(0.5))).otherwise(F.expr("cast(map() as map<string, double>)"))
    return e.select("id", F.size(F.map_concat(old, new)).alias("n_topics"))


def refresh_topics(stored: DataFrame, scraped: DataFrame, now, grace_hours: int = 48) -> DataFrame:
    """Topics (slug, name, source_ids, is_current, is_active, is_pinned, started_s, ended_s) after a refresh by scraped ones
    (slug, name, source_ids, started_s): those scraped are current and active, keep their start, have the ids of both and
    no end; new ones begin when they say, or now. Other current ones end now if they haven't, unless they are pinned or
    were discovered within the last two days. Slugs are trimmed; rows without one are left out; of a slug scraped twice the
    greatest row counts."""
    fresh = scraped.withColumn("slug", F.trim("slug")).where("slug <> ''").groupBy("slug").agg(F.max(F.struct("name", "source_ids", "started_s")).alias("new"))
    old = stored.select("slug", F.struct(*[c for c in stored.columns if c != "slug"]).alias("old"))
    j = old.join(fresh, "slug", "full_outer")
    seen, o, n = F.col("new").isNotNull(), F.col("old"), F.col("new")
    none = F.array().cast("array<string>")
    discovered = F.array_contains(F.coalesce(o["source_ids"], none), "event-discovery")
    in_grace = discovered & ~F.coalesce(now - o["started_s"] > grace_hours * 3_600, F.lit(False))
    stale = ~seen & o["is_current"] & o["is_active"] & ~F.coalesce(o["is_pinned"], F.lit(False)) & ~in_grace
    return j.select(
        "slug", F.when(seen, F.substring(F.coalesce(n["name"], "slug"), 1, 255)).otherwise(o["name"]).alias("name"),
        F.array_sort(F.array_union(F.coalesce(o["source_ids"], none), F.coalesce(n["source_ids"], none))).alias("source_ids"),
        F.when(seen, True).when(stale, False).otherwise(o["is_current"]).alias("is_current"), F.when(seen, True).otherwise(o["is_active"]).alias("is_active"), F.coalesce(o["is_pinned"], F.lit(False)).alias("is_pinned"),
        F.when(o.isNull(), F.coalesce(n["started_s"], now)).otherwise(o["started_s"]).alias("started_s"), F.when(seen, None).when(stale, F.coalesce(o["ended_s"], now)).otherwise(o["ended_s"]).alias("ended_s"),
    )


@query("r16_topic_refresh", """with o as (select 's' || c_custkey::varchar as slug, c_name as name, case when c_custkey % 5 = 0 then ['event-discovery'] else ['feed'] end as ids, c_custkey % 7 <> 0 as is_current, c_custkey % 11 <> 0 as is_active, c_custkey % 13 = 0 as is_pinned, 1000000 - (c_custkey % 4) * 86400 as started_s, case when c_custkey % 17 = 0 then 5 end as ended_s from customer where c_custkey % 2 = 0),
n as (select 's' || c_custkey::varchar as slug, c_name || '!' as name, ['feed', 'web'] as ids, case when c_custkey % 9 <> 0 then 77 end as started_s from customer where c_custkey % 3 = 0), j as (select coalesce(o.slug, n.slug) as slug, o.slug is not null as was, n.slug is not null as seen, o.*exclude(slug), n.name as n_name, n.ids as n_ids, n.started_s as n_started from o full join n on o.slug = n.slug),
k as (select *, not seen and is_current and is_active and not is_pinned and not (list_contains(ids, 'event-discovery') and 1000000 - started_s <= 172800) as stale from j)
select slug, coalesce(n_name, name) as name, array_to_string(list_sort(list_distinct(list_concat(coalesce(ids, []), coalesce(n_ids, [])))), ',') as source_ids, case when seen then true when stale then false else is_current end as is_current, seen or is_active as is_active, coalesce(is_pinned, false) as is_pinned,
 case when was then started_s else coalesce(n_started, 1000000) end as started_s, case when seen then null when stale then coalesce(ended_s, 1000000) else ended_s end as ended_s from k""")
def _(spark, d):
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    slug = F.concat(F.lit("s"), k.cast("string")).alias("slug")
    ids = lambda *names: F.array(*map(F.lit, names))
    stored = c.where("c_custkey % 2 = 0").select(slug, F.col("c_name").alias("name"), F.when(k % 5 == 0, ids("event-discovery")).otherwise(ids("feed")).alias("source_ids"), (k % 7 != 0).alias("is_current"), (k % 11 != 0).alias("is_active"), (k % 13 == 0).alias("is_pinned"), (1_000_000 - k % 4 * 86_400).alias("started_s"), F.when(k % 17 == 0, F.lit(5).cast("long")).alias("ended_s"))
    scraped = c.where("c_custkey % 3 = 0").select(F.concat(F.lit(" "), slug).alias("slug"), F.concat("c_name", F.lit("!")).alias("name"), ids("feed", "web").alias("source_ids"), F.when(k % 9 != 0, F.lit(77).cast("long")).alias("started_s"))
    return refresh_topics(stored, scraped, F.lit(1_000_000).cast("long")).withColumn("source_ids", F.array_join("source_ids", ","))

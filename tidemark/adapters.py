"""Logical tables (events, articles, bars, ...) made of the driver's tables by SQL that Spark and DuckDB read alike.

Numbers are multiples of 1/64, so that sums and means are the same in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = """
select event_id as id, ts as started_at, user_id,
  case event_type when 'click' then 'economic' when 'error' then 'conflict' when 'purchase' then 'political' when 'signup' then 'disaster' else 'health' end as category,
  case user_id % 12 when 0 then 'Moscow, Russia' when 1 then 'Kyiv, Ukraine' when 2 then 'Tehran, Iran' when 3 then 'Washington, United States' when 4 then 'Beijing, China'
    when 5 then 'Berlin, Germany' when 6 then 'Gulf of Mexico' when 7 then 'London, UK' when 8 then 'Delhi, India' when 9 then 'Tel Aviv, Israel' when 10 then 'Lima, Peru' end as location_name,
  case user_id % 7 when 0 then 'war' when 1 then 'airstrike' when 2 then 'markets' when 3 then 'energy' when 4 then 'election' when 5 then 'outbreak' else 'other' end as sub_category,
  case event_id % 4 when 0 then 'ukraine-war' when 1 then 'inflation,fed-rates' when 2 then 'crypto' else '' end as topics,
  case when event_id % 5 = 0 then null else (event_id % 129 - 64) / 64e0 end as finbert,
  case when event_id % 7 = 0 then null else ((event_id * 3) % 129 - 64) / 64e0 end as sentiment,
  case when event_id % 11 = 0 then null else (event_id % 65) / 64e0 end as intensity,
  1 + event_id % 9 as article_count,
  ((event_id * 37) % 1441 - 720) / 8e0 as latitude, ((event_id * 53) % 2881 - 1440) / 8e0 as longitude,
  case event_id % 3 when 0 then true when 1 then false end as is_deleted
from {events}"""

ARTICLES = """
select doc_id as id, source as source_code, lang, substr(text, 1, 60) as title, text as content, 1704067200 + doc_id * 1200 as published_s,
  case doc_id % 7 when 0 then 'conflict' when 1 then 'economic' when 2 then 'political' when 3 then 'disaster' when 4 then 'health' when 5 then 'general' end as category,
  case doc_id % 5 when 0 then 'Kyiv' when 1 then 'Tehran' when 2 then 'Berlin' when 3 then 'Lima' end as city,
  case doc_id % 5 when 0 then 'Ukraine' when 1 then 'Iran' when 2 then 'Germany' when 3 then 'Peru' end as country,
  case when doc_id % 9 = 0 then null else (doc_id % 65) / 64e0 end as intensity,
  case when doc_id % 8 = 0 then null else (doc_id % 129 - 64) / 64e0 end as sentiment,
  case when doc_id % 10 = 0 then null else ((doc_id * 5) % 129 - 64) / 64e0 end as finbert,
  case when doc_id % 13 = 0 then null else ((doc_id * 37) % 1441 - 720) / 8e0 end as latitude, ((doc_id * 53) % 2881 - 1440) / 8e0 as longitude,
  case doc_id % 6 when 0 then 'fetched' when 1 then 'annotated' when 2 then 'refine' else 'processed' end as stage,
  case doc_id % 4 when 0 then true when 1 then false end as is_deleted,
  doc_id % 3 as cluster
from {documents}"""

#: Long daily history: one symbol per order priority.
BARS = """
select o_orderpriority as symbol, cast(o_orderdate as date) as d, max(o_totalprice) as close,
  case when count(*) % 5 = 0 then null else cast(count(*) as double) end as volume
from {orders} group by o_orderpriority, cast(o_orderdate as date)"""

#: Short hourly history that overlaps the events: one symbol per event type; t counts seconds.
HOURS = """
select event_type as symbol, cast(floor(epoch_s / 3600) as bigint) * 3600 as t, max(value) + 100 as close, cast(count(*) as double) as volume
from (select event_type, value, {epoch} as epoch_s from {events} where value is not null) e group by event_type, cast(floor(epoch_s / 3600) as bigint) * 3600"""

FORECASTS = """
select o_orderkey as id, o_orderpriority as symbol, case o_custkey % 2 when 0 then 1 else 5 end as horizon_days, o_orderdate as generated_at,
  (o_orderkey * 7 % 65) / 64e0 as direction_prob, case when o_orderkey % 3 = 0 then null else (o_orderkey * 11 % 129 - 64) / 64e0 end as realized_return
from {orders}"""

SOURCES = """
select distinct source as code, concat('Source ', substr(source, 4, 9)) as name, cast(substr(source, 4, 9) as int) % 5 / 2e0 as weight,
  cast(substr(source, 4, 9) as int) % 7 = 0 as weight_locked from {documents} where cast(substr(source, 4, 9) as int) % 6 <> 5"""

TABLES = {"events": EVENTS, "articles": ARTICLES, "bars": BARS, "hours": HOURS, "forecasts": FORECASTS, "sources": SOURCES}
NEEDS = {"events": "events", "articles": "documents", "bars": "orders", "hours": "events", "forecasts": "orders", "sources": "documents"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table, or else the driver's table of that name; times without a zone are taken in the session's."""
    base = NEEDS.get(name, name)
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    df = df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])
    return spark.sql(TABLES[name].replace("{epoch}", "unix_timestamp(ts)"), **{base: df}) if name in TABLES else df


def cte(*names: str) -> str:
    """`with events_ as (...), ...` for DuckDB: the logical tables, each under its name and an underscore."""
    texts = [f"{n}_ as ({TABLES[n].replace('{epoch}', 'cast(floor(epoch(ts)) as bigint)').format(**{NEEDS[n]: NEEDS[n]})})" for n in names]
    return "with " + ", ".join(texts)

"""URL filters: dated list entries as validity intervals, met by an as-of join with the time of each capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, table

BLOCK_SECONDS = 3600


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www.; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def first_segment(url: Column) -> Column:
    """First path segment in lower case, or an empty string."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """What a list may name to meet a URL: its host, every parent domain of two labels or more, and host/first-segment."""
    host, segment = host_of(url), first_segment(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>")))))


def validity_intervals(entries: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """entries (entry_id, pattern, listed, ts) with valid_from and valid_to: until the next entry of the pattern, or null.

    Entries of one pattern at one time are in the order of entry_id; all but the last hold for no time. A pattern may
    have much of the list: entries are dealt by (pattern, block of time) and blocks tell each other one row each."""
    e = entries.where("pattern is not null and ts is not null").withColumn("block", F.floor(F.unix_timestamp("ts") / block_seconds))
    inside = Window.partitionBy("pattern", "block").orderBy("ts", "entry_id")
    firsts = e.groupBy("pattern", "block").agg(F.min("ts").alias("first_ts"))
    following = firsts.select("pattern", "block", F.lead("first_ts").over(Window.partitionBy("pattern").orderBy("block")).alias("next_block_ts"))
    return (
        e.withColumn("next_ts", F.lead("ts").over(inside))
        .join(following, ["pattern", "block"])
        .select("entry_id", "pattern", "listed", F.col("ts").alias("valid_from"), F.coalesce("next_ts", "next_block_ts").alias("valid_to"))
    )


def as_of_lists(captures: DataFrame, entries: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """captures (capture_id, url, ts) with host, matches, blocked, pattern, entry_id, valid_from, valid_to.

    A capture meets, for each pattern of its URL, the entry whose interval holds its time (valid_from <= ts < valid_to). It
    is blocked if one of these says listed; pattern, entry_id and the interval are of the listed entry with the longest
    pattern, then the greatest text. matches counts the entries met, listed or not. Captures without a URL, host or time
    meet nothing and are kept. What a capture meets depends on its URL and time alone: captures that share both, or repeat
    a capture_id, are probed once and get the same. Entries that repeat all but their entry_id follow each other in its
    order. Empty captures give no rows, empty entries match none; columns of captures named like an added one are replaced.

    The as-of step is one union of entries and probes with a window by (pattern, block of time), so that a pattern with a
    third of all rows is split by time; a block gets the last entry of earlier blocks as one row more.
    """
    spans = validity_intervals(entries, block_seconds).withColumn("entry", F.struct("valid_from", "entry_id", "listed", "valid_to"))
    block = lambda c: F.floor(F.unix_timestamp(c) / block_seconds)
    asked = captures.where("url is not null and ts is not null").select("url", "ts").distinct()
    probes = asked.select("url", "ts", F.explode(patterns_of(F.col("url"))).alias("pattern")).withColumn("block", block("ts"))
    known = spans.select("pattern", block("valid_from").alias("block"), "entry")
    last = known.groupBy("pattern", "block").agg(F.max("entry").alias("entry"))
    wanted = probes.select("pattern", "block").distinct().withColumn("entry", F.lit(None).cast(last.schema["entry"].dataType))
    earlier = Window.partitionBy("pattern").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.unionByName(wanted).groupBy("pattern", "block").agg(F.max("entry").alias("entry"))
        .select("pattern", "block", F.last("entry", ignorenulls=True).over(earlier).alias("entry")).where("entry is not null")
    )
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    entry_type = last.schema["entry"].dataType
    line = (
        known.select("pattern", "block", F.col("entry.valid_from").alias("at"), F.lit(1).alias("kind"), F.col("entry.entry_id").alias("order_id"), "entry", none("url", "string"))
        .unionByName(carried.select("pattern", "block", F.timestamp_seconds(F.col("block") * block_seconds).alias("at"), F.lit(0).alias("kind"), F.col("entry.entry_id").alias("order_id"), "entry", none("url", "string")))
        .unionByName(probes.select("pattern", "block", F.col("ts").alias("at"), F.lit(2).alias("kind"), none("order_id", spans.schema["entry_id"].dataType), none("entry", entry_type), "url"))
    )
    upto = Window.partitionBy("pattern", "block").orderBy("at", "kind", "order_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumn("entry", F.last("entry", ignorenulls=True).over(upto)).where("kind = 2 and entry is not null")
    best = F.struct(F.length("pattern").alias("n"), "pattern", "entry")
    verdict = met.groupBy("url", F.col("at").alias("ts")).agg(
        F.count("*").alias("matches"), F.max("entry.listed").alias("blocked"), F.max(F.when(F.col("entry.listed"), best)).alias("best")
    )
    own, names = numbered(captures.drop("host", "matches", "blocked", "pattern", "entry_id", "valid_from", "valid_to"))
    url, ts = names["url"], names["ts"]
    met = own.join(verdict, (F.col(url) == F.col("url")) & (F.col(ts) == F.col("ts")), "left")
    return met.select(
        *[F.col(n).alias(c) for c, n in names.items()], host_of(F.col(url)).alias("host"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
        "best.pattern", "best.entry.entry_id", "best.entry.valid_from", "best.entry.valid_to",
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """All pages, page k fetched k minutes into 2024, against a list with one dated entry from every page: its host, its
    domain or its host/first-segment (by page_id % 3), dated up to 3 days around the fetch, listing (page_id % 5 < 3) or
    delisting it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = lambda minutes: F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60)
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", at(F.col("page_id")).alias("ts"))
    host = host_of(F.col("url"))
    pattern = (
        F.when(F.col("page_id") % 3 == 0, host)
        .when(F.col("page_id") % 3 == 1, F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1))
        .otherwise(F.concat(host, F.lit("/"), first_segment(F.col("url"))))
    )
    entries = pages.select(
        F.col("page_id").alias("entry_id"), pattern.alias("pattern"), (F.col("page_id") % 5 < 3).alias("listed"), at(F.col("page_id") + (F.col("page_id") % 7 - 3) * 1440).alias("ts")
    )
    return as_of_lists(captures, entries).select(
        F.col("capture_id").alias("page_id"), "host", "matches", "blocked", "pattern", "entry_id", F.unix_timestamp("valid_from").alias("valid_from_s"), F.unix_timestamp("valid_to").alias("valid_to_s")
    )


OP10_SQL = r"""
with p as (
  select page_id, epoch(timestamp '2024-01-01')::bigint + page_id * 60 as ts,
         nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '^www\.', ''), '') as host,
         regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) as seg from pages
), e as (
  select page_id as entry_id, page_id % 5 < 3 as listed, ts + (page_id % 7 - 3) * 86400 as ts,
         case page_id % 3 when 0 then host when 1 then regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) else host || '/' || seg end as pattern from p
), v as (
  select *, lead(ts) over (partition by pattern order by ts, entry_id) as valid_to from e where pattern is not null
), q as (
  select page_id, ts, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    case when seg <> '' then [host || '/' || seg] else [] end))) as pattern from p where host is not null
), m as (
  select q.page_id, q.pattern, v.entry_id, v.listed, v.ts as valid_from, v.valid_to from q join v
    on q.pattern = v.pattern and v.ts <= q.ts and (v.valid_to is null or q.ts < v.valid_to)
), g as (
  select page_id, count(*) as matches, bool_or(listed) as blocked from m group by page_id
), b as (
  select * from m where listed qualify row_number() over (partition by page_id order by length(pattern) desc, pattern desc) = 1
)
select p.page_id, p.host, coalesce(g.matches, 0) as matches, coalesce(g.blocked, false) as blocked, b.pattern, b.entry_id, b.valid_from as valid_from_s, b.valid_to as valid_to_s
from p left join g using (page_id) left join b using (page_id)
"""

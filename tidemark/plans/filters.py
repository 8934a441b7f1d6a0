"""Filters and predicates, and the reads composed of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import text as T
from ..registry import query

EV, AR = cte("events"), cte("articles")


def alive(df: DataFrame, column: str = "is_deleted") -> DataFrame:
    """Rows not marked as deleted; an absent mark counts as alive."""
    return df.where(~F.col(column).eqNullSafe(True))


def between(df: DataFrame, column: str, start, end, closed: bool) -> DataFrame:
    """[start, end] of the interface, or [start, end) of the pipeline."""
    c = F.col(column)
    return df.where((c >= F.lit(start)) & ((c <= F.lit(end)) if closed else (c < F.lit(end))))


def in_box(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def tri_state(df: DataFrame, column: str, value: str | None, default: str | None = None) -> DataFrame:
    """true and false filter; any other word doesn't."""
    v = (value if value is not None else default or "").lower()
    return df.where(F.col(column).eqNullSafe(v in ("true", "1"))) if v in ("true", "1", "false", "0") else df


def capped(limit: str | int | None, default: int, most: int) -> int:
    try:
        return min(int(limit), most)
    except (TypeError, ValueError):
        return default


def window_pair(start, end):
    """Bounds come together or not at all."""
    if (start is None) != (end is None):
        raise ValueError("start and end must be given together")
    return start, end


def active_on(df: DataFrame, day, start: str, end: str) -> DataFrame:
    d = F.lit(day)
    return df.where((F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) >= d)))


def list_events(events: DataFrame, category=None, topic=None, symbol=None, box=None, start=None, end=None, limit=None) -> DataFrame:
    """The event list: all filters are optional; newest first, 100 rows by default and 500 at most."""
    df = alive(events)
    if category:
        df = df.where(F.col("category") == category)
    if topic:
        df = df.where(F.array_contains("topic_slugs", topic))
    if symbol:
        df = df.where(F.exists("affected", lambda a: a["symbol"] == symbol))
    if box:
        df = in_box(df, *box)
    if start:
        df = df.where(F.col("started_at") >= start)
    if end:
        df = df.where(F.col("started_at") <= end)
    return df.orderBy(F.desc("started_at"), F.desc("id")).limit(capped(limit, 100, 500))


@query("s01_s02_pruned_scan", EV + " select id, category from events_")
def _(spark, d):
    return load(spark, d, "events").select("id", "category")


@query("f01_alive", EV + " select id from events_ where is_deleted is distinct from true")
def _(spark, d):
    return alive(load(spark, d, "events")).select("id")


@query("f02_f08_equality", EV + " select id from events_ where category = 'conflict' and lower(location_name) = 'kyiv, ukraine'")
def _(spark, d):
    return load(spark, d, "events").where((F.col("category") == "conflict") & (F.lower("location_name") == F.lower(F.lit("KYIV, Ukraine")))).select("id")


@query("f03_closed_and_half_open", EV + """ select id, started_at < timestamp '2024-01-10' as half_open from events_ where started_at >= timestamp '2024-01-05' and started_at <= timestamp '2024-01-10'""")
def _(spark, d):
    closed = between(load(spark, d, "events"), "started_at", "2024-01-05", "2024-01-10", True)
    return closed.select("id", (F.col("started_at") < "2024-01-10").alias("half_open"))


@query("f04_in_list_semi_join", EV + " select id from events_ where category in (select category from events_ where id < 2) and user_id in (1, 2, 3)")
def _(spark, d):
    e = load(spark, d, "events")
    return e.where(F.col("user_id").isin(1, 2, 3)).join(e.where("id < 2").select("category"), "category", "left_semi").select("id")


@query("f05_f06_null_tests", EV + " select id, finbert is null as no_finbert, intensity is not null as rated from events_ where topics is distinct from 'crypto' and location_name is distinct from 'Lima, Peru'")
def _(spark, d):
    e = load(spark, d, "events").where(~F.col("topics").eqNullSafe("crypto") & ~F.col("location_name").eqNullSafe("Lima, Peru"))
    return e.select("id", F.col("finbert").isNull().alias("no_finbert"), F.col("intensity").isNotNull().alias("rated"))


@query("f07_or_predicate", EV + " select id from events_ where intensity is null or (intensity > 0.5 and category <> 'health')")
def _(spark, d):
    return load(spark, d, "events").where(F.col("intensity").isNull() | ((F.col("intensity") > 0.5) & (F.col("category") != "health"))).select("id")


@query("f09_f11_array_membership", EV + " select id, len(list_filter(string_split(topics, ','), lambda x: x <> '')) = 0 as untagged from events_ where list_contains(string_split(topics, ','), 'inflation') or topics = ''")
def _(spark, d):
    e = load(spark, d, "events").withColumn("slugs", F.filter(F.split("topics", ","), lambda x: x != ""))
    return e.where(F.array_contains("slugs", "inflation") | (F.size("slugs") == 0)).select("id", (F.size("slugs") == 0).alias("untagged"))


@query("f12_nested_map_predicate", EV + " select id from events_ where (id % 3 = 0 and intensity > 0.25) is false")
def _(spark, d):
    e = load(spark, d, "events")
    status = F.create_map(F.lit("route"), F.struct(((F.col("id") % 3 == 0) & (F.col("intensity") > 0.25)).alias("ok")))
    return e.withColumn("stage_status", status).where(F.col("stage_status")["route"]["ok"] == F.lit(False)).select("id")


@query("f13_bounding_box", EV + " select id, latitude, longitude from events_ where latitude between -10 and 40 and longitude between 20 and 90.5")
def _(spark, d):
    return in_box(load(spark, d, "events"), -10, 20, 40, 90.5).select("id", "latitude", "longitude")


@query("f14_f15_params", EV + " select id from events_ where is_deleted is not distinct from false order by id desc limit 500")
def _(spark, d):
    return tri_state(load(spark, d, "events"), "is_deleted", None, "false").orderBy(F.desc("id")).limit(capped("9999", 100, 500)).select("id")


@query("f16_active_on", "select p_partkey as id from part where (p_size % 4 = 0 or p_size <= 20) and (p_size % 5 = 0 or p_size + 10 >= 20)")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("s"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 10).alias("e"))
    return active_on(p, 20, "s", "e").select(F.col("p_partkey").alias("id"))


@query("f17_filter_after_limit", EV + " select id from (select * from events_ order by started_at desc, id desc limit 200) where category = 'economic'")
def _(spark, d):
    return load(spark, d, "events").orderBy(F.desc("started_at"), F.desc("id")).limit(200).where("category = 'economic'").select("id")


@query("f18_f19_calendar", "select o_orderkey as id from orders where o_orderdate >= timestamp '1996-12-01' and o_orderdate < timestamp '1997-01-01'")
def _(spark, d):
    start = F.make_timestamp(F.lit(1996), F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return load(spark, d, "orders").where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < F.add_months(start, 1))).select(F.col("o_orderkey").alias("id"))


@query("f20_f21_junk_url", r"""with p as (select page_id, lower(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')) as path from pages)
select page_id, path = '' or len(list_intersect(string_split(path, '/'), ['people','staff','contact','contact-us','author','authors','tag','tags','category','categories','about','about-us','topic','topics','advisor','for-media','press','media-center'])) > 0
  or regexp_matches(string_split(path, '/')[-1], '^\d+x\d+([_-]|$)') as junk from p""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.is_junk_article(F.lit("A title"), F.col("url")).alias("junk"))


@query("f22_f23_paywall_and_good_body", f"""with m as (select page_id, html as t, lower(regexp_extract(html, '(?i){T.PAYWALL}')) as m from pages)
select page_id, m <> '' and strpos(lower(t), m) - 1 <= length(t) * 0.6 as wall, length(t) >= 600 and not (m <> '' and strpos(lower(t), m) - 1 <= length(t) * 0.6) as good from m""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.is_paywall(F.col("html")).alias("wall"), T.is_good_body(F.col("html")).alias("good"))


@query("f24_boilerplate", r"""with p as (select page_id, unnest(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)) as b from pages),
q as (select page_id, b, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as t,
  array_to_string(list_transform(regexp_extract_all(b, '(?is)<a[^>]*>(.*?)</a>', 1), lambda a: regexp_replace(a, '(?s)<[^>]+>', ' ', 'g')), ' ') as l from p)
select page_id, count(*) as paragraphs, count(*) filter (where t = '' or (length(t) < 15 and not regexp_matches(t, '[.!?]\s*$')) or (length(t) <= 200 and l <> '' and length(l) / length(t) >= 0.6)) as chrome from q group by page_id""")
def _(spark, d):
    p = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))).alias("b"))
    return p.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.count_if(T.is_boilerplate(F.col("b"))).alias("chrome"))


@query("f30_importance_bands", AR + """ select case when 10 * intensity >= 7 then 'high' when 10 * intensity >= 4 then 'medium' when intensity is not null then 'low' else 'none' end as band, count(*) as n from articles_ group by 1""")
def _(spark, d):
    i = 10 * F.col("intensity")
    band = F.when(i >= 7, "high").when(i >= 4, "medium").when(i.isNotNull(), "low").otherwise("none")
    return load(spark, d, "articles").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("f33_reprocess_anti_join", AR + " select id from articles_ where not (stage = 'processed' and id % 2 = 0)")
def _(spark, d):
    a = load(spark, d, "articles")
    current = a.where("stage = 'processed' and id % 2 = 0").select("id")
    return a.join(current, "id", "left_anti").select("id")


@query("f35_text_search", AR + " select id from articles_ where contains(lower(title), 'the') and lang = 'en'")
def _(spark, d):
    return load(spark, d, "articles").where(F.contains(F.lower("title"), F.lit("the")) & (F.col("lang") == "en")).select("id")


@query("api_events", EV + """ select e.id, e.category, coalesce(n.n_name, e.location_name) as place from (select * from events_ where is_deleted is distinct from true and category = 'economic' and latitude between -80 and 80 and longitude between -170 and 170
 and list_contains(string_split(topics, ','), 'inflation') order by started_at desc, id desc limit 500) e left join nation n on n.n_nationkey = e.user_id % 30""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("topic_slugs", F.split("topics", ","))
    rows = list_events(e, category="economic", topic="inflation", box=(-80, -170, 80, 170), limit=1000)
    nation = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")  # 25 rows
    return rows.join(F.broadcast(nation), F.col("user_id") % 30 == F.col("k"), "left").select("id", "category", F.coalesce("n_name", "location_name").alias("place"))

"""Price and event features, labels, trailing sigma, folds, baselines, routing evaluation, model training."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import cte, load
from ..functions import routing as R
from ..functions.decisions import decision
from ..functions.numbers import places
from ..operators.joins import interval_join
from ..operators.model import assembled, forecast, train
from ..operators.tables import written
from ..registry import query
from .joins_ import ROUTE

BA = cte("bars")
MIN_HISTORY, SIGMA_ROWS, SIGMA_LEAST = 25, 30, 20
EVENT_WINDOWS = (1, 3, 7)
CATEGORIES = ["conflict", "economic", "political", "disaster", "health"]
TOPICS = list(R.TOPIC_SYMBOLS)


def price_features(bars: DataFrame, by: str = "symbol", at: str = "d") -> DataFrame:
    """bars (by, at, close, volume) with returns, volatility, momentum, RSI, volume z-score, and the row's number `pos`.

    All but the z-score are windows over one sort by (symbol, time). The z-score takes the last 20 volumes that are there,
    over the rows with a volume alone; a row without one has that of the row before."""
    w = Window.partitionBy(by).orderBy(at)
    last = lambda n: w.rowsBetween(1 - n, 0)
    close = F.col("close")
    ret = lambda n: F.coalesce(close / F.lag("close", n).over(w) - 1, F.lit(0.0))
    b = bars.withColumn("pos", F.row_number().over(w) - 1).withColumn("diff", close - F.lag("close").over(w)).withColumn("logret", F.log(close / F.lag("close").over(w)))
    gain, loss = F.avg(F.greatest("diff", F.lit(0.0))).over(last(14)), F.avg(F.greatest(-F.col("diff"), F.lit(0.0))).over(last(14))
    there = Window.partitionBy(by, F.isnull("volume")).orderBy(at)
    b = b.withColumn("v", F.collect_list("volume").over(there.rowsBetween(-19, 0))).withColumn("rsi_gain", gain).withColumn("rsi_loss", loss)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.col("v")) / F.nullif(F.size("v"), F.lit(0))
    b = b.withColumn("vm", mean)
    b = b.withColumn("vs", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("vm")) * (x - F.col("vm"))) / F.nullif(F.size("v") - 1, F.lit(0))))
    z = F.when((F.size("v") > 2) & (F.col("vs") > 0), (F.element_at("v", -1) - F.col("vm")) / F.col("vs")).otherwise(0.0)
    b = b.withColumn("z", F.when(F.col("volume").isNotNull(), z))
    return b.select(
        by, at, "close", "pos", ret(1).alias("ret_1d"), ret(5).alias("ret_5d"), ret(20).alias("ret_20d"),
        F.coalesce(F.stddev_samp("logret").over(last(20)), F.lit(0.0)).alias("vol_20d"), (close / F.avg("close").over(last(20)) - 1).alias("mom_sma20"),
        F.when(F.col("pos") < 14, 0.5).when(F.col("rsi_loss") == 0, 1.0).otherwise(1 - 1 / (1 + F.col("rsi_gain") / F.col("rsi_loss"))).alias("rsi_14"),
        F.coalesce(F.last("z", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("vol_z"),
    )


def labels(bars: DataFrame, horizons=(1, 5), by: str = "symbol", at: str = "d") -> DataFrame:
    w = Window.partitionBy(by).orderBy(at)
    ahead = {h: F.lead("close", h).over(w) / F.col("close") - 1 for h in horizons}
    return bars.select(by, at, *[x for h, r in ahead.items() for x in (r.alias(f"y_ret_{h}"), F.when(r.isNotNull(), (r > 0).cast("int")).alias(f"y_dir_{h}"))])


def event_features(bars: DataFrame, routed: DataFrame, by: str = "symbol", at: str = "t", day: int = 86400, step: int = 3600) -> DataFrame:
    """Sums, counts and maxima of the weights of events of the last 1, 3 and 7 days, a decayed sum, sentiment of 3 days,
    category counts of 3 days and topics of 7, per bar; bars without events get zeros. Events after the bar never count.

    routed: (symbol, s, weight, finbert, sentiment, category, topics) with s in seconds; bars: (symbol, t), t multiples of
    `step` seconds, as the windows are. So events are first combined by (symbol, step they fall in), those on the very
    second of a step apart, and a bar meets one row per step, however many events there are."""
    weight, s = F.col("weight"), F.col("s")
    cell = F.ceil(s / step) * step
    sums = [F.sum("weight").alias("w"), F.count("*").alias("n"), F.max(F.abs(weight)).alias("most"), F.sum(weight * F.exp(-(cell - s) / day / 3)).alias("decayed")]
    sums += [F.sum("finbert").alias("fs"), F.count("finbert").alias("fn"), F.min("finbert").alias("fm"), F.sum("sentiment").alias("ss"), F.count("sentiment").alias("sn")]
    sums += [F.count_if(F.col("category") == c).alias(f"cat_{c}") for c in CATEGORIES]
    sums += [F.max(F.array_contains("topics", t)).alias(f"topic_{t.replace('-', '_')}") for t in TOPICS]
    cells = routed.where("weight is not null and weight <> 0").groupBy(by, cell.alias("cell"), (F.pmod(s, F.lit(step)) == 0).alias("exact")).agg(*sums)
    spans = bars.select(by, at, (F.col(at) - 7 * day).alias("_lo"), F.col(at).alias("_hi"))
    met = interval_join(cells, spans, "cell", "_lo", "_hi", 7 * day, [by])
    age = (F.col(at) - F.col("cell")) / day
    within = lambda w: (age < w) | ((age == w) & F.col("exact"))  # noqa: E731  a cell on the edge begins before it
    aggs = []
    for w in EVENT_WINDOWS:
        inside = lambda c, w=w: F.when(within(w), F.col(c))
        aggs += [F.sum(inside("w")).alias(f"evw_sum_{w}d"), F.sum(inside("n")).cast("double").alias(f"evw_cnt_{w}d"), F.max(inside("most")).alias(f"evw_maxabs_{w}d")]
    recent = lambda c: F.when(within(3), F.col(c))
    aggs += [F.sum(F.when(within(7), F.col("decayed") * F.exp(-age / 3))).alias("evw_decay_7d"), (F.sum(recent("fs")) / F.nullif(F.sum(recent("fn")), F.lit(0))).alias("news_finbert_mean")]
    aggs += [F.min(recent("fm")).alias("news_finbert_min"), (F.sum(recent("ss")) / F.nullif(F.sum(recent("sn")), F.lit(0))).alias("news_sentiment_mean")]
    aggs += [F.sum(recent(f"cat_{c}")).cast("double").alias(f"cat_{c}") for c in CATEGORIES]
    aggs += [F.max(F.when(within(7), F.col(f"topic_{t.replace('-', '_')}")).cast("double")).alias(f"topic_{t.replace('-', '_')}") for t in TOPICS]
    g = met.groupBy(by, at).agg(*aggs)
    names = [c for c in g.columns if c not in (by, at)]
    return bars.select(by, at).join(g, [by, at], "left").select(by, at, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def training_frame(bars: DataFrame, routed: DataFrame | None, horizons=(1, 5), by: str = "symbol", at: str = "t", day: int = 86400, symbols: tuple[str, ...] = ()) -> DataFrame:
    """Features and labels of every bar with 25 before it and the longest horizon after it; with `symbols`, a column each
    that tells whose bar it is."""
    frame = price_features(bars, by, at).join(labels(bars, horizons, by, at), [by, at])
    if routed is not None:
        frame = frame.join(event_features(bars, routed, by, at, day), [by, at])
    frame = frame.withColumns({f"sym_{s}": (F.col(by) == s).cast("double") for s in symbols})
    return frame.where((F.col("pos") >= MIN_HISTORY) & F.col(f"y_ret_{max(horizons)}").isNotNull())


def trailing_sigma(bars: DataFrame, by: str = "symbol", at: str = "d") -> DataFrame:
    """Sample deviation of the 30 returns before each bar; null below 20 of them."""
    w = Window.partitionBy(by).orderBy(at)
    r = bars.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    before = w.rowsBetween(-SIGMA_ROWS, -1)
    return r.withColumn("sigma", F.when(F.count("ret").over(before) >= SIGMA_LEAST, F.stddev_samp("ret").over(before)))


def folds(frame: DataFrame, at: str, start: int, end: int, step: int, window: int) -> DataFrame:
    """Each row once per fold and role: train in (origin - window, origin], test in (origin, origin + step]."""
    origins = frame.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end - step), F.lit(step))).alias("origin"))
    of = F.col(at)
    return frame.join(F.broadcast(origins), (of > F.col("origin") - window) & (of <= F.col("origin") + step)).withColumn("role", F.when(of <= F.col("origin"), "train").otherwise("test"))


def leaks(folded: DataFrame, at: str) -> DataFrame:
    """Folds whose training rows aren't all before their test rows; none, if all is well."""
    g = folded.groupBy("origin").agg(F.max(F.when(F.col("role") == "train", F.col(at))).alias("last"), F.min(F.when(F.col("role") == "test", F.col(at))).alias("first"))
    return g.where("last > origin or first <= origin")


def walk_forward(frame: DataFrame, features: list[str], label: str, origins: list[int], window: int, at: str = "t", least: int = 50, trees: int = 5, seed: int = 7, side_by_side: int = 4) -> DataFrame:
    """(origin, symbol, at, y, p) of the rows after each origin up to the next, from trees fitted on the window before it.
    Origins with too few rows, or rows of one direction, are left out; no rows if all are. One fit per origin: origins are
    few, rows may be many; a few fits run side by side, so that one's small steps don't leave the cluster idle."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows = written(assembled(frame, features).select("symbol", at, "features", F.col(label).cast("double").alias("label"), F.col(label).alias("y")), "walk")
    of = lambda origin: (F.col(at) > origin - window) & (F.col(at) <= origin)
    counts = rows.agg(*[F.struct(F.count_if(of(o)).alias("n"), F.min(F.when(of(o), F.col("label"))).alias("lo"), F.max(F.when(of(o), F.col("label"))).alias("hi")).alias(f"o{k}") for k, o in enumerate(origins[:-1])]).first() if len(origins) > 1 else ()
    wanted = [(o, after) for o, after, c in zip(origins, origins[1:], counts) if c["n"] >= least and c["lo"] < c["hi"]]

    def one(fold: tuple[int, int]) -> DataFrame:
        origin, following = fold
        p = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed).fit(rows.where(of(origin))).transform(rows.where((F.col(at) > origin) & (F.col(at) <= following)))
        return p.select(F.lit(origin).cast("long").alias("origin"), "symbol", at, "y", vector_to_array("probability")[1].alias("p"))

    with ThreadPoolExecutor(side_by_side) as pool:
        parts = list(pool.map(one, wanted))
    none = rows.limit(0).select(F.lit(0).cast("long").alias("origin"), "symbol", at, "y", F.lit(0.0).alias("p"))
    return functools.reduce(DataFrame.unionByName, parts, none)


@query("w01_w07_price_features", BA + """, w as (select *, row_number() over s - 1 as pos, close - lag(close) over s as diff, ln(close / lag(close) over s) as lr from bars_ window s as (partition by symbol order by d)),
x as (select *, avg(greatest(diff, 0)) over l14 as g, avg(greatest(-diff, 0)) over l14 as l, coalesce(close / lag(close) over s - 1, 0) as ret_1d, coalesce(close / lag(close, 5) over s - 1, 0) as ret_5d, coalesce(close / lag(close, 20) over s - 1, 0) as ret_20d,
 coalesce(stddev_samp(lr) over l20, 0) as vol_20d, close / avg(close) over l20 - 1 as mom_sma20, lead(close, 5) over s / close - 1 as y_ret_5
 from w window s as (partition by symbol order by d), l14 as (partition by symbol order by d rows 13 preceding), l20 as (partition by symbol order by d rows 19 preceding))
select symbol, d, pos::bigint as pos, round(ret_1d, 6) as ret_1d, round(ret_5d, 6) as ret_5d, round(ret_20d, 6) as ret_20d, round(vol_20d, 6) as vol_20d, round(mom_sma20, 6) as mom_sma20, round(case when pos < 14 then 0.5 when l = 0 then 1 else 1 - 1 / (1 + g / l) end, 6) as rsi_14, (y_ret_5 > 0)::int as y_dir_5 from x where pos >= 25 and y_ret_5 is not null""")
def _(spark, d):
    b = load(spark, d, "bars")
    f = price_features(b).join(labels(b, (5,)), ["symbol", "d"]).where(f"pos >= {MIN_HISTORY} and y_ret_5 is not null")
    return f.select("symbol", "d", F.col("pos").cast("long").alias("pos"), *[F.round(c, 6).alias(c) for c in ("ret_1d", "ret_5d", "ret_20d", "vol_20d", "mom_sma20", "rsi_14")], "y_dir_5")


@query("w05_volume_z", BA + """, v as (select symbol, d, volume, row_number() over (partition by symbol order by d) as k from bars_ where volume is not null), w as (select symbol, d, (volume - avg(volume) over l) / nullif(stddev_samp(volume) over l, 0) as z, count(*) over l as n from v window l as (partition by symbol order by d rows 19 preceding))
select b.symbol, b.d, round(coalesce(case when w.n > 2 then w.z end, 0), 6) as vol_z from bars_ b asof left join w on b.symbol = w.symbol and b.d >= w.d""")
def _(spark, d):
    return price_features(load(spark, d, "bars")).select("symbol", "d", F.round("vol_z", 6).alias("vol_z"))


@query("w08_trailing_sigma", BA + """, r as (select *, close / lag(close) over (partition by symbol order by d) - 1 as ret from bars_)
select symbol, d, round(case when count(ret) over w >= 20 then stddev_samp(ret) over w end, 6) as sigma from r window w as (partition by symbol order by d rows between 30 preceding and 1 preceding)""")
def _(spark, d):
    return trailing_sigma(load(spark, d, "bars")).select("symbol", "d", F.round("sigma", 6).alias("sigma"))


@query("w09_population_sigma", BA + " select symbol, d, round(stddev_pop(close) over (partition by symbol order by d range between interval 60 days preceding and current row), 4) as sigma from bars_")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.datediff("d", F.lit("1995-01-01"))).rangeBetween(-60, 0)
    return load(spark, d, "bars").select("symbol", "d", F.round(F.stddev_pop("close").over(w), 4).alias("sigma"))


def routed_hours(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), (F.col("id") % 5 + 1).cast("int")).alias("symbol"), F.unix_timestamp("started_at").alias("s"), ((F.col("id") * 5 % 129 - 64) / 64).alias("weight"), "finbert", "sentiment", "category", F.split("topics", ",").alias("topics"))


@query("w10_w12_event_features", cte("hours", "events") + """, r as (select ['click','error','purchase','signup','view'][1 + (id % 5)::int] as symbol, floor(epoch(started_at))::bigint as s, (id * 5 % 129 - 64) / 64 as weight, finbert, sentiment, category, string_split(topics, ',') as topics from events_),
m as (select h.symbol, h.t, r.*exclude(symbol), (h.t - r.s) / 86400 as age from hours_ h join r on r.symbol = h.symbol and r.s <= h.t and r.s >= h.t - 604800 where weight <> 0),
g as (select symbol, t, coalesce(sum(weight) filter (where age <= 1), 0) as evw_sum_1d, count(*) filter (where age <= 3) as evw_cnt_3d, max(abs(weight)) as evw_maxabs_7d, round(sum(weight * exp(-age / 3)), 6) as evw_decay_7d, coalesce(avg(finbert) filter (where age <= 3), 0) as news_finbert_mean,
 count(*) filter (where age <= 3 and category = 'conflict') as cat_conflict, max(list_contains(topics, 'crypto')::int) as topic_crypto from m group by 1, 2)
select h.symbol, h.t, coalesce(evw_sum_1d, 0)::double as evw_sum_1d, coalesce(evw_cnt_3d, 0)::double as evw_cnt_3d, coalesce(evw_maxabs_7d, 0)::double as evw_maxabs_7d, coalesce(evw_decay_7d, 0)::double as evw_decay_7d, coalesce(news_finbert_mean, 0)::double as news_finbert_mean, coalesce(cat_conflict, 0)::double as cat_conflict, coalesce(topic_crypto, 0)::double as topic_crypto from hours_ h left join g using (symbol, t)""")
def _(spark, d):
    f = event_features(load(spark, d, "hours"), routed_hours(spark, d))
    return f.select("symbol", "t", "evw_sum_1d", "evw_cnt_3d", "evw_maxabs_7d", F.round("evw_decay_7d", 6).alias("evw_decay_7d"), "news_finbert_mean", "cat_conflict", "topic_crypto")


@query("w13_training_frame")
def _(spark, d):
    return training_frame(load(spark, d, "hours"), routed_hours(spark, d), symbols=("click", "error", "purchase", "signup", "view"))


@query("w14_latest_forecasts", cte("forecasts") + " select symbol, horizon_days, id, direction_prob from forecasts_ qualify row_number() over (partition by symbol, horizon_days order by generated_at desc, id desc) = 1")
def _(spark, d):
    # An aggregate, not a window: combined before the shuffle, however many forecasts a symbol has.
    g = load(spark, d, "forecasts").groupBy("symbol", "horizon_days").agg(F.max_by(F.struct("id", "direction_prob"), F.struct("generated_at", "id")).alias("r"))
    return g.select("symbol", "horizon_days", "r.id", "r.direction_prob")


@query("w15_w16_latest_and_last_n", BA + " select symbol, d, close, r = 1 as latest from (select *, row_number() over (partition by symbol order by d desc) as r from bars_) where r <= 10")
def _(spark, d):
    b = load(spark, d, "bars").withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("r <= 10")
    return b.select("symbol", "d", "close", (F.col("r") == 1).alias("latest"))


@query("w17_rebase", BA + " select symbol, d, (close / first_value(close) over (partition by symbol order by d) - 1) * 100 as pct from bars_ where d >= date '1997-01-01'")
def _(spark, d):
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("d"))
    return load(spark, d, "bars").where("d >= date '1997-01-01'").select("symbol", "d", ((F.col("close") / first - 1) * 100).alias("pct"))


@query("w18_a40_weekly_regression", BA + """, w as (select symbol, d - ((dayofweek(d)))::int as week, arg_max(close, d) as close, sum(coalesce(volume, 0)) as x from bars_ group by 1, 2), r as (select *, lead(close) over (partition by symbol order by week) / close - 1 as y from w)
select symbol, count(*) as n, round(regr_slope(y, x), 6) as b, round(regr_intercept(y, x), 6) as a, round(regr_r2(y, x), 6) as r2 from r where y is not null group by 1 having count(*) >= 8""")
def _(spark, d):
    week = F.date_sub("d", F.dayofweek("d") - 1)  # Sunday
    w = load(spark, d, "bars").groupBy("symbol", week.alias("week")).agg(F.max_by("close", "d").alias("close"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("x"))
    r = w.withColumn("y", F.lead("close").over(Window.partitionBy("symbol").orderBy("week")) / F.col("close") - 1).where("y is not null")
    return r.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("b"), F.round(F.regr_intercept("y", "x"), 6).alias("a"), F.round(F.regr_r2("y", "x"), 6).alias("r2")).where("n >= 8")


FOLD = BA + """, y as (select symbol, date_diff('day', date '1995-01-01', d) as t, lead(close) over (partition by symbol order by d) / close - 1 as y from bars_), o as (select unnest(generate_series(500, 2000 - 100, 100)) as origin),
f as (select *, case when t <= origin then 'train' else 'test' end as role from y join o on t > origin - 365 and t <= origin + 100 where y is not null)"""


def _labelled_days(spark, d) -> DataFrame:
    b = load(spark, d, "bars")
    return labels(b, (1,)).where("y_ret_1 is not null").select("symbol", F.datediff("d", F.lit("1995-01-01")).alias("t"), F.col("y_ret_1").alias("y"))


@query("w19_w20_walk_forward_naive", FOLD + """, g as (select origin, avg((y > 0)::int) filter (where role = 'train') as up_rate, count(*) filter (where role = 'train') as n_train, count(*) filter (where role = 'test') as n_test from f group by 1)
select g.*, avg(((y > 0) = (up_rate >= 0.5))::int) as accuracy from g join f using (origin) where role = 'test' and n_train >= 50 group by all""")
def _(spark, d):
    f = folds(_labelled_days(spark, d), "t", 500, 2000, 100, 365)
    train, up = F.col("role") == "train", F.col("y") > 0
    # Counts of ups tell the accuracy of a constant prediction: no second join.
    g = f.groupBy("origin").agg(F.avg(F.when(train, up.cast("int"))).alias("up_rate"), F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.avg(F.when(~train, up.cast("int"))).alias("hit"))
    return g.where("n_train >= 50 and n_test > 0").select("origin", "up_rate", "n_train", "n_test", F.when(F.col("up_rate") >= 0.5, F.col("hit")).otherwise(1 - F.col("hit")).alias("accuracy"))


@query("w22_leakage", FOLD + """, s as (select origin, case when origin % 300 = 200 and role = 'test' then t - 7 else t end as t, role from f)
select origin, max(t) filter (where role = 'train') as last, min(t) filter (where role = 'test') as first from s group by 1 having max(t) filter (where role = 'train') > origin or min(t) filter (where role = 'test') <= origin""")
def _(spark, d):
    # Every third fold is spoilt, its test rows set back by a week: those and no others must be told.
    f = folds(_labelled_days(spark, d), "t", 500, 2000, 100, 365)
    spoilt = (F.col("origin") % 300 == 200) & (F.col("role") == "test")
    return leaks(f.withColumn("t", F.when(spoilt, F.col("t") - 7).otherwise(F.col("t"))), "t").select(F.col("origin").cast("long").alias("origin"), F.col("last").cast("long").alias("last"), F.col("first").cast("long").alias("first"))


@query("a29_return_mae", FOLD + """, m as (select origin, avg(y) filter (where role = 'train') as p from f group by 1), e as (select f.origin, abs(y - p) as em, abs(y) as ez from f join m using (origin) where role = 'test')
select coalesce(origin, -1) as origin, count(*) as n, round(avg(em), 6) as mae_model, round(avg(ez), 6) as mae_zero, round((1 - avg(em) / avg(ez)) * 100, 4) as improvement_pct from e group by rollup(origin)""")
def _(spark, d):
    f = folds(_labelled_days(spark, d), "t", 500, 2000, 100, 365)
    m = f.where("role = 'train'").groupBy("origin").agg(F.avg("y").alias("p"))  # a row per fold
    e = f.where("role = 'test'").join(F.broadcast(m), "origin").select("origin", F.abs(F.col("y") - F.col("p")).alias("em"), F.abs("y").alias("ez"))
    g = e.rollup("origin").agg(F.count("*").alias("n"), F.avg("em").alias("m"), F.avg("ez").alias("z"))
    return g.select(F.coalesce("origin", F.lit(-1)).cast("long").alias("origin"), "n", F.round("m", 6).alias("mae_model"), F.round("z", 6).alias("mae_zero"), F.round((1 - F.col("m") / F.col("z")) * 100, 4).alias("improvement_pct"))


def precision_at_k(routed: DataFrame, moves: DataFrame, k: int = 3) -> DataFrame:
    """One row: of each event's k symbols of the largest weights, those with a usable move (event, symbol, ret, affected),
    how many were affected, beside the share of all pairs of an event and a symbol; and how often the direction of an
    affected one was right. To 4 places; shares of nothing are null. Of equal weights the smaller symbol counts first."""
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.abs("weight")).alias("o"), "symbol", "weight"))), 1, k)
    top = routed.groupBy("event").agg(first.alias("t")).select("event", F.explode("t").alias("t")).select("event", "t.symbol", "t.weight")
    met = top.join(moves, ["event", "symbol"])
    base = moves.join(routed.select("event").distinct(), "event", "left_semi").agg(places(F.avg(F.col("affected").cast("int")), 4).alias("random_baseline"))
    right = F.when(F.col("affected"), ((F.col("weight") > 0) == (F.col("ret") > 0)).cast("int"))
    hits = met.agg(F.count_distinct("event").alias("n_events"), F.count("*").alias("slots"), F.count_if("affected").alias("hits"), places(F.avg(F.col("affected").cast("int")), 4).alias("precision_at_k"), places(F.avg(right), 4).alias("direction_accuracy_on_hits"))
    return hits.crossJoin(F.broadcast(base))  # one row each


@query("a28_t08_precision_at_k", ROUTE.replace("select id, symbol, round_even(case when (sent", ", routed as (select id, symbol, round_even(case when (sent", 1).replace("4) as weight from g", "4) as weight from g)", 1) + """,
m as (select id as event, s.symbol, ((id * 7 + length(s.symbol) * 3) % 13 - 6)::double as ret, (id * 5 + length(s.symbol)) % 3 = 0 as affected from events_, (values ('CL=F'), ('GC=F'), ('BTC-USD'), ('SPY')) s(symbol) where id % 10 <> 0),
k as (select *, row_number() over (partition by id order by abs(weight) desc, symbol) as r from routed), t as (select k.id, m.*, k.weight from k join m on m.event = k.id and m.symbol = k.symbol where r <= 2)
select count(distinct id) as n_events, count(*) as slots, count(*) filter (where affected) as hits, round_even(avg(affected::int), 4) as precision_at_k, round_even(avg(((weight > 0) = (ret > 0))::int) filter (where affected), 4) as direction_accuracy_on_hits, (select round_even(avg(affected::int), 4) from m where event in (select id from routed)) as random_baseline from t""")
def _(spark, d):
    e = load(spark, d, "events")
    routes = R.route(e.withColumns({"topic_slugs": F.split("topics", ","), "sub_categories": F.array("sub_category"), "route_sentiment": F.coalesce("finbert", "sentiment")})).select(F.col("id").alias("event"), "symbol", "weight")
    pairs = e.where("id % 10 <> 0").select(F.col("id").alias("event"), F.explode(F.array(*map(F.lit, ("CL=F", "GC=F", "BTC-USD", "SPY")))).alias("symbol"))
    i, n = F.col("event"), F.length("symbol")
    moves = pairs.select("event", "symbol", ((i * 7 + n * 3) % 13 - 6).cast("double").alias("ret"), ((i * 5 + n) % 3 == 0).alias("affected"))
    return precision_at_k(routes, moves, 2)


@query("c38_c39_decision", cte("forecasts") + """ select id, case when direction_prob > 0.55 then 'up' when direction_prob < 0.45 then 'down' else 'flat' end as direction, abs(direction_prob - 0.5) * 2 as confidence, (direction_prob > 0.5) = (realized_return > 0) as is_correct from forecasts_""")
def _(spark, d):
    p = F.col("direction_prob")
    return load(spark, d, "forecasts").select("id", F.when(p > 0.55, "up").when(p < 0.45, "down").otherwise("flat").alias("direction"), (F.abs(p - 0.5) * 2).alias("confidence"), ((p > 0.5) == (F.col("realized_return") > 0)).alias("is_correct"))


def _frame(spark, d) -> tuple[DataFrame, list[str]]:
    frame = written(training_frame(load(spark, d, "hours"), routed_hours(spark, d)), "frame")
    return frame, [c for c in frame.columns if c not in ("symbol", "t", "close", "pos") and not c.startswith("y_")]


@query("u15_u16_direction_model")
def _(spark, d):
    """Decisions for the last fifth of the time by a model of the four before it, with its own band."""
    frame, features = _frame(spark, d)
    begin = frame.agg(F.percentile_approx("t", 0.8)).first()[0]
    model = train(frame.where(F.col("t") <= begin), features, "y_dir_1", "y_ret_1", ["t", "symbol"])
    out = forecast(frame.where(F.col("t") > begin), model)
    x = decision(F.col("close"), F.col("proba_up"), F.col("change"), F.lit(model.resid_std))
    return out.select("symbol", "t", "y_dir_1", x.alias("x")).select("symbol", "t", "y_dir_1", "x.*")


@query("u17_walk_forward_model")
def _(spark, d):
    frame, features = _frame(spark, d)
    lo, hi = frame.agg(F.min("t"), F.max("t")).first()
    step = (hi - lo) // 5
    p = walk_forward(frame, features, "y_dir_1", [lo + step * i for i in range(2, 6)], 2 * step)
    right = ((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int")
    return p.groupBy("origin").agg(F.count("*").alias("n_test"), F.avg(right).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))

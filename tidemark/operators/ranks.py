"""Exact quantiles and ordinal ranks of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import forget, sized, written

BINS = 1_024


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Number of the bin of a value in [lo, hi], never falling as the value grows; lo and hi are in different ones.

    Zero, signs and infinities apart first, then magnitudes that are far apart by their logarithms, then equal steps."""

    def steps(v: Column, lo: Column, hi: Column) -> Column:
        wide = hi / lo > 4
        part = F.when(wide, (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))).otherwise((v - lo) / (hi - lo))
        return F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")

    inf = F.lit(float("inf"))
    return (
        F.when((lo == -inf) | (hi == inf), F.when(v == -inf, 0).when(v < inf, 1).otherwise(2))
        .when((lo <= 0) & (hi >= 0), F.signum(v).cast("int") + 1)
        .when(lo > 0, steps(v, lo, hi))
        .otherwise(BINS - 1 - steps(-v, -hi, -lo))
    )


def exact_quantiles(rows: DataFrame, by: str, value: str, probs: list[float]) -> DataFrame:
    """(by, n, q0, q1, ...): the quantiles of the values of each group, one column per probability, interpolated between
    neighbours; null values and NaN are left out, groups without a value too; a null group is a group.

    A quantile is enclosed by an interval. Each round counts the values inside by bins, with the least and the greatest of
    each, and goes on with the bin that holds its rank, until that has one value; then one pass finds the next value. A
    round is one reading; it combines before it shuffles at most 1,024 rows a quantile and task, whatever a group's size.
    """
    v = rows.select(F.col(by).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    place = F.col("p.at") * (F.col("n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("at")) for i, p in enumerate(probs)])).alias("p")
    targets = v.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("*", wanted)
    targets = targets.select("k", "n", F.col("p.i").alias("i"), F.floor(place).alias("rank"), (place - F.floor(place)).alias("rest"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    targets = written(targets, "quantiles")
    same = F.col("k").eqNullSafe(F.col("tk"))
    while not targets.where("lo < hi").isEmpty():
        open_ = sized(targets.where("lo < hi").select(F.col("k").alias("tk"), "i", "lo", "hi"), "open")
        inside = v.join(open_, same & F.col("v").between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy("tk", "i", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy("tk", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # of BINS rows at most
        bins = bins.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumnRenamed("i", "ti")
        hit = (F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c"))
        found = targets.join(bins, same & (F.col("i") == F.col("ti")) & hit, "left")
        new = lambda c, t: F.coalesce(F.col(c), F.col(t)).alias(t)
        former, targets = targets, written(found.select("k", "n", "i", "rank", "rest", new("least", "lo"), new("most", "hi"), (F.col("below") + F.coalesce("before", F.lit(0))).alias("below")), "quantiles")
        forget(former)
    ends = sized(targets.where("rest > 0").select(F.col("k").alias("tk"), F.col("i").alias("ti"), F.col("lo").alias("at")), "ends")
    upto = v.join(ends, same).groupBy("tk", "ti").agg(F.count_if(F.col("v") <= F.col("at")).alias("upto"), F.min(F.when(F.col("v") > F.col("at"), F.col("v"))).alias("next"))
    both = targets.join(upto, same & (F.col("i") == F.col("ti")), "left")
    after = F.when(F.col("rank") + 1 < F.col("upto"), F.col("lo")).otherwise(F.col("next"))
    quantile = F.when(F.col("rest") > 0, F.col("lo") + (after - F.col("lo")) * F.col("rest")).otherwise(F.col("lo"))
    return both.groupBy("k").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == i, quantile)).alias(f"q{i}") for i in range(len(probs))]).withColumnRenamed("k", by)


def ordinal_ranks(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with `name`: the place, from 1, of each within its group in the order of the columns, which tell all rows of a
    group apart (rows that they don't tell apart have some order); nulls come first; a null group is a group.

    Rows are sorted by ranges of (group, order) and written; a row's place is that within its range and group, and what
    earlier ranges have of the group. So a group is spread, and the window runs over a row per range and group."""
    placed = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    pieces = placed.groupBy(F.col(by).alias("_k"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sized(pieces.select("_k", "_p", (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_from")), "pieces")
    same = F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))
    return placed.join(pieces, same).select(*rows.columns, (F.col("_at") - F.col("_from") + 1).alias(name))

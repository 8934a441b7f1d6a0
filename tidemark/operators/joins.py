"""Joins that Spark has no operator for: as-of, interval, token overlap, keyed upsert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_arrow, written


def _time_block(at: Column, kind: str, width: float) -> Column:
    """Number of the block of `width` days (dates and timestamps) or units (numbers) that holds a time."""
    if kind == "date":
        at = F.datediff(at, F.lit("1970-01-01"))
    elif kind.startswith("timestamp"):
        at = F.unix_timestamp(at) / 86_400
    return F.floor(at / width)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], strict: bool = False, width: float = 32) -> DataFrame:
    """left with the columns `take` of the last right row of the same key at or before left_at (before it, if strict).

    One union and one window sorted by time within (key, block of time), instead of a join on an inequality: cost is that
    of a sort, and a key with much of the rows is spread over its blocks. A block gets the last right row of earlier blocks
    as one row more; what finds it is a window over one row per key and block. width: of a block, in days for dates and
    timestamps, in units of the time for numbers. Of right rows at one time the greatest wins. A null time meets nothing."""
    block = _time_block(F.col("_t"), right.schema[right_at].dataType.simpleString(), width).alias("_b")
    found = F.struct(F.col(right_at).alias("_at"), *take)
    of_left = left.select(F.struct("*").alias("l")).schema["l"].dataType
    r = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("_t"), found.alias("_f")).select("*", block)
    l = left.where(F.col(left_at).isNotNull()).select(*by, F.col(left_at).alias("_t"), F.struct("*").alias("_l")).select("*", block)  # noqa: E741
    kind = r.schema["_f"].dataType
    last = r.groupBy(*by, "_b").agg(F.max("_f").alias("_f"))
    asked = l.select(*by, "_b").distinct().withColumn("_f", F.lit(None).cast(kind))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(asked).groupBy(*by, "_b").agg(F.max("_f").alias("_f")).withColumn("_f", F.last("_f", ignorenulls=True).over(earlier)).where("_f is not null")
    none = F.lit(None).cast(of_left).alias("_l")
    line = (
        carried.select(*by, "_b", F.col("_f._at").alias("_t"), F.lit(0).alias("_k"), "_f", none)
        .unionByName(r.select(*by, "_b", "_t", F.lit(2 if strict else 0).alias("_k"), "_f", none))
        .unionByName(l.select(*by, "_b", "_t", F.lit(1).alias("_k"), F.lit(None).cast(kind).alias("_f"), "_l"))
    )
    upto = Window.partitionBy(*by, "_b").orderBy("_t", "_k", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumn("_f", F.last("_f", ignorenulls=True).over(upto)).where("_l is not null").select("_l.*", *[F.col("_f")[c].alias(c) for c in take])
    types = right.schema
    return met.unionByName(left.where(F.col(left_at).isNull()).select("*", *[F.lit(None).cast(types[c].dataType).alias(c) for c in take]))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of points and spans with start <= at <= end, of whole numbers. Each span goes to the buckets of `width` that it
    touches and each point to one, so the join is on equality; width should be about the length of a span."""
    by = by or []
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def overlap_pairs(left: DataFrame, right: DataFrame, id_left: str, id_right: str, tokens: str) -> DataFrame:
    """(id_left, id_right, common, n_left, n_right) of rows that share a token: an equality join on tokens, never a cross join."""
    a = left.select(id_left, F.size(tokens).alias("n_left"), F.explode(tokens).alias("_w"))
    b = right.select(id_right, F.size(tokens).alias("n_right"), F.explode(tokens).alias("_w"))
    return a.join(b, "_w").groupBy(id_left, id_right).agg(F.count("*").alias("common"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"))


def similar_sets(rows: DataFrame, id_: str, tokens: str, num: int, den: int, least: int = 0) -> DataFrame:
    """(a, b) with a < b: rows whose sets of tokens have a Jaccard similarity of num/den or more, one of them with `least`
    tokens at least.

    Of two such sets, one has a token among the n - ceil(n * num/den) + 1 rarest of either: only those meet in an equality
    join, so a common word brings no pairs; sizes must fit, and then the whole sets decide. Empty sets meet nothing."""
    seen = rows.select(F.explode(tokens).alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
    words = rows.select(F.col(id_).alias("_id"), F.size(tokens).alias("_size"), F.explode(tokens).alias("_w")).join(seen, "_w")
    ranked = words.groupBy("_id", "_size").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_ws"))
    rare = ranked.select("_id", "_size", F.explode(F.slice("_ws", 1, F.expr(f"cast(_size - ceil(_size * {num} / {den}) + 1 as int)"))).alias("_x")).select("_id", "_size", "_x._w")
    left = rare.where(F.col("_size") >= least).select("_w", F.col("_id").alias("a"), F.col("_size").alias("na"))
    right = rare.select("_w", F.col("_id").alias("b"), F.col("_size").alias("nb"))
    pairs = left.join(right, "_w").where(f"(a < b or a > b and nb < {least}) and {den} * least(na, nb) >= {num} * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: rows.select(F.col(id_).alias(x), F.col(tokens).alias(f"t{x}"))
    common = "size(array_intersect(ta, tb))"
    return pairs.join(of("a"), "a").join(of("b"), "b").where(f"{den} * {common} >= {num} * (size(ta) + size(tb) - {common})").select("a", "b")


#: Sets of more tokens have too many subsets; they meet others as pairs.
SUBSET_TOKENS = 12


def _subsets(num: int, den: int):
    """Of rows (id, tokens: hashes), the subsets that a set of num/den similarity can have in common with it, as two sums of
    hashes, with the subset's and the set's number of tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            sizes, flat = np.diff(tokens.offsets.to_numpy()), tokens.flatten().to_numpy().view(np.uint64)
            begin = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
                bits = bits[bits.sum(1) * den >= num * n].astype(np.uint64)
                of = np.flatnonzero(sizes == n)
                for some in np.array_split(of, -(-len(of) * len(bits) // (1 << 18))):
                    h = flat[begin[some][:, None] + np.arange(n)]
                    other = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    sums = [(x @ bits.T).reshape(-1).view(np.int64) for x in (h, other ^ (other >> np.uint64(32)))]
                    common = np.tile(bits.sum(1).astype(np.int32), len(some))
                    ids = batch.column("id").take(pa.array(np.repeat(some, len(bits))))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), n, np.int32)), pa.array(common), *map(pa.array, sums)], ["id", "n", "common", "h1", "h2"])

    return work


def near_labels(rows: DataFrame, id_: str, tokens: str, labels: str, num: int, den: int, most: int, subset_tokens: int = SUBSET_TOKENS) -> DataFrame:
    """(id_, labels): the distinct labels of the rows whose sets of tokens have a Jaccard similarity of num/den or more to a
    row's, its own too; of those with more than `most`, that many at least. Sets are distinct and not empty.

    Two sets of a and b tokens are that similar if they share a subset of c tokens with num * (a + b) <= (num + den) * c. So
    each set goes to the keys of its subsets that are large enough, a key gathers the labels of each size of set, `most` at
    most, and a set takes from its keys: no pair is formed, however many sets are near each other, and no set is
    compared. Larger sets than subset_tokens meet others in similar_sets()."""
    rows = rows.select(F.col(id_).alias("id"), F.col(tokens).alias("tokens"), F.col(labels).alias("labels"))
    small, kind = rows.where(F.size("tokens") <= subset_tokens), rows.schema["id"].dataType.simpleString()
    # A set has some 60 keys: as many tasks make them as the session shuffles to.
    hashed = small.select("id", F.transform("tokens", lambda w: F.xxhash64(w)).alias("tokens")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    keys = map_arrow(hashed, _subsets(num, den), f"id {kind}, n int, common int, h1 long, h2 long")
    shared = keys.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2")
    held = written(keys.join(shared, ["h1", "h2"]), "subsets")
    told = held.join(small.select("id", "labels"), "id").select("h1", "h2", "n", F.explode("labels").alias("label")).groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("n", "label"))).alias("told"))
    told = told.withColumn("told", F.filter("told", lambda x, i: (i < most) | (F.get("told", i - most)["n"] != x["n"])))
    fits = F.filter("told", lambda x: num * (x["n"] + F.col("n")) <= (num + den) * F.col("common"))
    near = held.join(told, ["h1", "h2"]).select("id", F.explode(F.slice(F.array_distinct(F.transform(fits, lambda x: x["label"])), 1, most)).alias("label"))
    found = near.unionByName(rows.select("id", F.explode("labels").alias("label")))
    if not rows.where(F.size("tokens") > subset_tokens).isEmpty():
        pairs = similar_sets(rows, "id", "tokens", num, den, subset_tokens + 1)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = found.unionByName(both.join(rows.select(F.col("id").alias("b"), "labels"), "b").select(F.col("a").alias("id"), F.explode("labels").alias("label")))
    return found.groupBy("id").agg(F.collect_set("label").alias("labels")).withColumnRenamed("id", id_)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current plus the incoming rows whose key it doesn't have; the first of an incoming key by its whole row."""
    fresh = incoming.dropDuplicates().groupBy(*keys).agg(F.min(F.struct(*incoming.columns)).alias("r")).select("r.*")
    return current.unionByName(fresh.join(current.select(*keys), keys, "left_anti"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: Column, create_only: list[str] | None = None) -> DataFrame:
    """Rows of both by key: the last incoming row of a key, by order, replaces the current one, except in the columns
    create_only, which keep what the current row has."""
    create_only = create_only or []
    values = [c for c in incoming.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("new"))
    both = current.select(*keys, F.struct(*values).alias("old")).join(last, keys, "full_outer")
    pick = lambda c: F.when(F.col("old").isNotNull() & F.lit(c in create_only), F.col(f"old.{c}")).when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return both.select(*keys, *map(pick, values))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)

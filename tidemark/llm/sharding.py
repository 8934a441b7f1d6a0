"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, table, written

def two_pass_shuffle(
    docs: DataFrame, n_shards: int = 8, bucket_bytes: int = 32 << 20, seed: int = 17, text: str = "text"
) -> DataFrame:
    """docs in a uniformly random order, cut into n_shards shards; adds size, law, bucket, shard and slot.

    Pass 1 scatters the records with a seeded hash into as many buckets as hold bucket_bytes each, a bucket a task. Pass 2
    permutes each bucket by Fisher-Yates and writes it to the shared folder. The buckets one after the other are the new
    order; shards are equal runs of it, so the law is `rows`: counts of shards are at most one apart. slot counts from 0 in
    each shard. What is counted and what is returned are the written buckets, so retries can't make them differ.

    The hash takes the record's place in the input, so that copies and rows without an id scatter as well as others. A
    task holds one bucket: for 100 TB give bucket_bytes of some hundred MB, which makes some 100,000 of them. A null text
    has size 1; a long one counts whole; columns of any type may be there. Empty docs give no rows. Columns of docs named
    like an added one are replaced.
    """
    docs = docs.drop("size", "law", "bucket", "shard", "slot")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n_buckets = max(n_shards, math.ceil(total / bucket_bytes))

    place = docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns], size.alias("size")).alias("row"))
    scattered = place.select(F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64(F.lit(seed + 1), "place").alias("draw"), "place", "row")
    gathered = scattered.repartitionById(n_buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("draw", "place", "row")).alias("rows"))
    # The order that a bucket has before it is permuted is that of the draws; only they are sorted, rows may have any type.
    order = F.transform(F.sort_array(F.transform("rows", lambda x, i: F.struct(x["draw"].alias("draw"), x["place"].alias("place"), i.alias("i")))), lambda x: x["i"])
    permuted = F.transform(F.shuffle(order, F.lit(seed)), lambda i: F.get("rows", i)["row"])
    # shuffle() draws from one stream per task: the order of buckets must not vary.
    dealt = gathered.sortWithinPartitions("bucket").select("bucket", F.posexplode(permuted).alias("pos", "row"))
    dealt = written(dealt, "buckets")

    # Where each bucket begins: running counts, first of blocks of 1024 buckets, then within the blocks.
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr("bucket div 1024"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    starts = counts.join(F.broadcast(blocks), "block").select(
        "bucket", (F.col("base") + F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("start")
    )
    starts = sized(starts, "starts")
    n = starts.join(counts, "bucket").agg(F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0))).first()[0]
    placed = dealt.join(starts, "bucket").withColumn("place", F.col("start") + F.col("pos"))
    shard = F.expr(f"cast((place * {n_shards}) div {max(n, 1)} as int)")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select("row.*", F.lit("rows").alias("law"), "bucket", "shard", "slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes the rows below path/shard=N; in each shard, files and rows stand in the order of slot."""
    shuffled.repartitionByRange("shard", "bucket", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is rows)."""
    return two_pass_shuffle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

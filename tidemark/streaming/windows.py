"""Structured Streaming: tumbling event-time windows, deduplication with a time limit, keyed state in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType



def event_windows(events: DataFrame, at: str, by: list[str], width: str = "3 days", late: str = "7 days") -> DataFrame:
    """Counts and weights per tumbling window and key. Rows later than `late` are left out, and a window's state is dropped
    once it is that old: so in append mode, which gives each window when it is closed, and in update mode, which gives every
    change of one. (Complete mode keeps both.)"""
    w = F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("article_count").alias("articles"), F.max(at).alias("last")).select(F.unix_timestamp("w.start").alias("start_s"), *by, "n", "articles", F.unix_timestamp("last").alias("last_s"))


def first_seen(events: DataFrame, keys: list[str], at: str, ttl: str = "24 hours") -> DataFrame:
    """The first row of each key; a key is forgotten after the time limit."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def batches_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that run() has written below folder, in any of its runs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out/{n}/_SUCCESS")))


def run(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all files there are that it hasn't read, into Parquet below folder, and gives all that it has
    written there, in this run and, after a restart on the same folder, in earlier ones: all rows appended; the last
    complete result; or, of updates, the last row of each of the keys. A batch that is retried writes its own files anew."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    numbers = batches_of(spark, folder)
    paths = [f"{folder}/out/batch={n}" for n in (numbers[-1:] if mode == "complete" else numbers)]
    if not paths:
        return spark.createDataFrame([], schema)
    if mode != "update":
        return spark.read.schema(schema).parquet(*paths)
    changes = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{folder}/out").parquet(*paths)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.fieldNames() if c not in keys]), "batch").alias("r")).select(*keys, "r.*")


def keyed_table(spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps the row of the greatest `order` of each key in one table below path, in buckets of a
    hash of the key: a batch reads and rewrites the buckets that its keys fall into, the files of others stay. The new files
    of a bucket replace the old ones when all are written. A retried batch finds its own rows at most, so the result is
    the same. Rows of equal order: the one there stays. Number of buckets: so that one is some 100 MB."""

    def write(batch: DataFrame, n: int = 0) -> None:
        columns = batch.columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*").select("*", bucket).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
            if not touched:
                return
            merged = new.withColumn("_old", F.lit(0))
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
                merged = merged.unionByName(old.withColumn("_old", F.lit(1)))
            best = F.max_by(F.struct(*columns, "bucket"), F.struct(order, "_old"))
            out = merged.groupBy(*keys).agg(best.alias("r")).select("r.*").repartition(len(touched), "bucket")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        finally:
            new.unpersist()

    return write


def reaggregation_windows(now: Column, hours: int, grid_days: int = 3) -> tuple[Column, Column]:
    """(from, to) in seconds of a trailing recomputation that late rows call for: the last `hours`, begun on a grid cell, so
    that a cell is always recomputed whole and its upsert replaces it."""
    cell = grid_days * 86_400
    return F.floor((now - hours * 3_600) / cell) * cell, now


def tiles(start: Column, end: Column, days: int = 30, grid_days: int = 3) -> Column:
    """array<struct<start, end>> in seconds: history cut into tiles of `days`, rounded down to whole grid cells."""
    width = max(days // grid_days, 1) * grid_days * 86_400
    begin = F.floor(start / width) * width
    return F.transform(F.sequence(begin, F.greatest(begin, end - 1), F.lit(width)), lambda t: F.struct(t.alias("start"), (t + width).alias("end")))


def is_due(last: Column, now: Column, every_minutes: Column) -> Column:
    """A stage runs if it never did, or its cadence has passed."""
    return last.isNull() | (now - last >= every_minutes * 60)


def summary(batch: DataFrame) -> DataFrame:
    """What is published after a batch."""
    return batch.agg(F.count("*").alias("n"), F.max("magnitude").alias("strongest"))

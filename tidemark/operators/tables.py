"""Tables between steps in the shared folder, work on Arrow batches with this package at hand, connected components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode, as in tests, a temporary one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and lost executors cost nothing.

    The files go by forget(), or when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    _paths[again] = path
    return again


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As written(), with the rows of a column's hash in files of their own, so that joins on it deal only their other side.

    As many buckets as the session has shuffle partitions; a task writes a file per bucket it has rows of, so this is
    for few large rows."""
    spark = df.sparkSession
    table = f"tidemark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tidemark/{table}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(table)
    atexit.register(_delete, spark, path)
    again = spark.table(table)
    _paths[again] = path
    return again


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave; nothing may still have to read them."""
    for df in tables:
        if df in _paths:
            _delete(df.sparkSession, _paths.pop(df))


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: a batch stands in the JVM and in Python, once
#: on its way in and once on its way out, in every task of an executor.
BATCH_BYTES, _BATCH_BYTES_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, and has batches of texts small."""
    if spark.conf.get(_BATCH_BYTES_KEY) == f"{64 << 20}b":
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def give_back() -> None:
    """Memory that was freed goes back to the system: workers wait between tasks, and live as long as the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(function, schema), with this package on the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def sized(df: DataFrame, name: str, most_rows: int = 1_000_000, length: Column | None = None) -> DataFrame:
    """df written; marked for broadcast only if it has most_rows of a few short columns at most, else joined by shuffle.

    length: of a row's one longer column, in short values; its sum counts in place of the rows."""
    df = written(df, name)
    n = df.agg(F.count("*") if length is None else F.coalesce(F.sum(length + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most_rows else df


def spanning_forest(a: pa.Array, b: pa.Array) -> pa.Table:
    """Edges as stars around the smallest node of what they connect."""
    ids, of = np.unique(np.concatenate([a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)]), return_inverse=True)
    left, right = of[: len(a)], of[len(a) :]
    root = np.arange(len(ids))
    while (root[left] != root[right]).any():
        least = root.copy()
        np.minimum.at(least, root[left], root[right])
        np.minimum.at(least, root[right], root[left])
        while (least[least] != least).any():
            least = least[least]
        root = least[root]
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[tied], a.type), "b": pa.array(ids[root[tied]], a.type)})


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the edges of each batch alone connect."""
    for batch in batches:
        yield from spanning_forest(batch.column("a"), batch.column("b")).to_batches()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Distributed union-find over edges (a, b): one row (id, component) per node that has an edge, component being the
    smallest id of its connected component.

    Batches of edges become stars where they lie. Then the large-star and small-star contractions alternate, whose
    rounds grow with the logarithm of a component's size; both aggregate before they shuffle, the join may split a hub's
    rows, and each round is written to the shared folder, the one before it deleted. Empty edges give an empty table;
    loops, repeated edges and either order are fine, nulls are left out.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = map_arrow(edges.where("a is not null and b is not null and a <> b").select("a", "b"), _local_forest, f"a {kind}, b {kind}")
    pairs = written(pairs.distinct(), "edges")
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(pairs)
    for _ in range(max_rounds):
        # Large star: every neighbour above a node is tied to the least of the node and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its neighbours below it are tied to the least of those.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        former, pairs = pairs, written(small, "components")
        forget(former)
        now = state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)

"""Writers: append, insert if absent, keyed update, history with current state, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import insert_new, upsert


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: list[str], path: str) -> None:
    """Appends the rows whose key isn't there yet."""
    insert_new(current.limit(0), incoming.join(current.select(*keys), keys, "left_anti"), keys).write.mode("append").parquet(path)


def update_by_key(current: DataFrame, incoming: DataFrame, keys: list[str], order: Column, path: str) -> None:
    """Writes the merged table to another path than current's."""
    upsert(current, incoming, keys, order).write.mode("overwrite").parquet(path)


def merge_state(current: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Current state after a full listing: rows seen are replaced and active, the others stay and are inactive."""
    values = [c for c in current.columns if c not in (key, "is_active")]
    j = current.select(key, F.struct(*values).alias("old")).join(seen.dropDuplicates([key]).select(key, F.struct(*values).alias("new")), key, "full_outer")
    return j.select(key, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values], F.col("new").isNotNull().alias("is_active"))


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""What several operators share: reading tables; tables between steps and connected components are those of all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import bucketed, components, forget, give_back, map_arrow, shared_folder, ship_package, sized, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(docs with numbered column names, own name to number), so that nothing an operator adds meets a column of docs."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names

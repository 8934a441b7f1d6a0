"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import table, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("minhash_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("bpe", stages.tokenise),
]

#: Fitted models, hashes of signatures and automata aren't SQL; tests/llm holds run() against its parts by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

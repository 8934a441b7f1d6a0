"""The operators as stages of a corpus pipeline: documents in, documents with the stage's decisions carried out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, lines, minhash, toxicity
from .common import numbered, sized, table


def _own(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, fitted on the labelled ones of docs, finds toxic."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    rows, names = numbered(docs)
    return toxicity.classify(rows, chain, names["text"]).where("not is_toxic").select(*_own(names))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line once; n_chars, if there, follows the text. No document goes, though its text may become empty."""
    return lines.without_repeated_lines(docs, length="n_chars" if "n_chars" in docs.columns else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest doc_id of each class of texts, with a text of that class; rows without a doc_id or a text stay."""
    gone = sized(minhash.classified(docs).where("doc_id <> class_id").select("doc_id", "h1", "h2").distinct(), "copies")
    rows, names = numbered(docs)
    doc, text = names["doc_id"], names["text"]
    same = (F.col(doc) == F.col("doc_id")) & (F.xxhash64(text) == F.col("h1")) & (F.xxhash64(F.lit(1), text) == F.col("h2"))
    return rows.join(gone, same, "left_anti").select(*_own(names))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    rows, names = numbered(docs)
    return decontamination.screen(rows, table(spark, sf_dir, "benchmark"), names["text"]).where("size(matches) = 0").select(*_own(names))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digests(docs, bpe.public_vocabulary())

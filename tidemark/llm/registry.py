"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, exponion, lines, minhash, ngram, pii, sharding, spelling, toxicity, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1,
    "op2_pii": pii.op2,
    "op3_toxicity": toxicity.op3,
    "op4_decontamination": decontamination.op4,
    "op5_sharding": sharding.op5,
    "op6_bpe": bpe.op6,
    "op7_minhash": minhash.op7,
    "op8_vectors": vectors.op8,
    "op9_line_dedup": lines.op9,
    "op10_url_filters": urls.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_lm_scoring": ngram.op12,
    "op13_vector_codes": exponion.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op8_vectors": vectors.OP8_SQL,
    "op10_url_filters": urls.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_vector_codes": exponion.OP13_SQL,
}

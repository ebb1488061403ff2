"""The queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, fm_index, jaccard, language_id, line_dedup, mixing, repetition, site_quality, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": repetition.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_site_quality": site_quality.op8_site_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_fm_index": fm_index.op10_fm_index,
}

#: Where SQL says the same; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op3_ngram_jaccard": jaccard.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_quality_rules": repetition.SQL,
    "op6_mixing": mixing.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_language_id": language_id.SQL,
    "op10_fm_index": fm_index.SQL,
}

"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import media, packing, pii, quality, secret_scan, sentence_piece, simhash, suffix_dedup, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_media": media.op3_media,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_pii": pii.op7_pii,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sentencepiece": sentence_piece.op9_sentencepiece,
    "op10_topk": topk.op10_topk,
}
ORACLE_SQL: dict[str, str] = {"op10_topk": topk.ORACLE_SQL}

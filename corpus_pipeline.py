"""From raw documents to packed sequences: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs. All
but the last return the columns of documents:

- toxicity drops the documents that the clause grammar, trained on the folder's labels, rejects;
- near_dedup keeps one document of each group of linked SimHash fingerprints, that with the smallest id;
- suffix_dedup cuts passages of over 50 words that another document holds too from the text, all occurrences, and keeps the row;
- secrets masks the spans found, trained on the documents it is given;
- packing tokenises the rest and returns the pieces with their places (see weft.llm.packing).

Changed texts update n_chars. Null texts stay null or become empty, and no stage but the first two drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import packing, secret_scan, simhash, suffix_dedup, toxicity
from weft.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.trained(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_each(docs)


def suffix_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_passages(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("suffix_dedup", suffix_cut), ("secrets", mask_secrets), ("packing", pack)]

#: XXH64 fingerprints, the trained models and the tokenizer can't be expressed in DuckDB SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

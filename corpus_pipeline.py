"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  It is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

Defined cases: rows with a null or empty text have no words, so the quality rules reject them; rows of one id, or without
one, are told apart by all their columns, and of repeated rows one stays after near dedup; a null source is a source of
its own in the mix; ids tie in the order of their token ids; extra columns stay up to the last stage, whatever their
names; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspan.llm import decontaminate, mixing, near_dedup, orc, quality
from quadspan.llm.shared import new_path, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id."""
    return near_dedup.near_dedup(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32."""
    at = new_path(spark, "token_ids")
    orc.write_token_ids(docs, at)
    return orc.token_report(spark, at)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

#: MinHash, random ranks and tokenizers have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        at = new_path(spark, f"stage{k}")
        out.write.parquet(at)
        release(spark)
        docs = spark.read.parquet(at)
    return docs

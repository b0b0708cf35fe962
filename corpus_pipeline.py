"""A corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes what the one before it kept, as it was written and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import packing, quality, secret_scan, simhash_groups
from skein.llm.common import new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the smallest doc_id.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard
    likeness of 0.8 or more: SimHash tries find them, the sets confirm them.
    """
    return simhash_groups.keep_one(docs, words=5, threshold=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the texts; n_chars follows."""
    return secret_scan.redact(docs, n_chars="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts: the pieces of each document and their ids."""
    from public_tokenizers import PATTERN, path

    return packing.pack(docs, path("byte_bpe_50k.tiktoken"), PATTERN, end_id=1)


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Hashed n-gram scores, SimHash and BPE ids can't be told in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents``; every stage is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: STAGES in order over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import bpe, mixing, quality_rules, secrets, simhash
from matchloom.llm.common import documents, materialize, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts with them (they have no words). Repeated rows are
    judged alike; an empty table stays empty."""
    small_batches(spark)
    return quality_rules.drop_rejected(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the least doc_id (null last). The rule is that of the
    fingerprints: three words a shingle, up to 3 of 64 bits. Repeated rows and all null or empty texts are one component;
    an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked where they stand; every document stays, those with null texts or ids as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document comes as often as it is taken, which may be never or several times. A null
    source is one of its own; texts without words add nothing."""
    return mixing.in_training_order(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix, and digests of them and of the decoded bytes; null texts have none."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: No SQL: the perplexity model, SimHash, the forest and the tokenizer can't be stated in it; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

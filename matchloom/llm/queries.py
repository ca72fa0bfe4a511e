"""The registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversations, language_id, mixing, packed, quality_model, quality_rules, secrets, separators, sharding, simhash, syncmers
from .common import documents

#: Size of the vocabulary of byte_bpe_50k.json, and its end-of-document id.
VOCABULARY, END_OF_TEXT = 50257, 50256


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label, score and verdict of every document."""
    return quality_model.classify(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; values as digests."""
    found = secrets.scan(documents(spark, sf_dir))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its first position in training; rows come in that order."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=("doc_id",))
    position = F.round(F.get("positions", F.lit(0)), 6).alias("position")
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", position)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files: doc_id, file, start, n_tokens."""
    return separators.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_OF_TEXT)


def op5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to packed files and read back: doc_id, start, n_tokens, ids_crc32."""
    return packed.read_packed(packed.write_packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2, VOCABULARY))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by DuckDB queries: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over all documents: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicate_components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near equal bytes."""
    found = sharding.shard(documents(spark, sf_dir), 24)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the perplexity verdict of every document."""
    return quality_rules.judge(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", "v.*")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return syncmers.edited(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations.collocations(documents(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation; the repaired turns as a digest."""
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(damaged, F.col("present")).withColumnRenamed("sha256", "repaired_sha256")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    return language_id.identify(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_model, op2_secrets, op3_mixing, op4_token_counts, op5_packed, op6_bpe, op7_simhash, op8_sharding, op9_quality_rules, op10_syncmers, op11_collocations, op12_conversations, op13_language_id)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op11_collocations": collocations.ORACLE, "op12_conversations": conversations.ORACLE}

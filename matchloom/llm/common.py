"""What several operators share: the shared folder, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word: a run of anything but ASCII white space. bytes.split() finds the same runs.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The rows written to the shared folder (under a new path if none is given) and read back: cuts lineage and outlives
    lost executors."""
    path = path or fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows that Spark hands to a Python worker at once, at most, where they are whole texts.
AT_ONCE = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on, in this session, Python workers get AT_ONCE rows at once: what both sides hold of them stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= AT_ONCE:
        spark.conf.set(name, str(AT_ONCE))

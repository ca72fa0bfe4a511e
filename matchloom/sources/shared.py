"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, a folder of this machine, on a local master
    only: on a cluster the executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='matchloom-')}")
    return at.rstrip("/")


def write_shared(df: DataFrame, name: str | None = None) -> DataFrame:
    """df written under ``name`` (a new one if not given) and read back: cuts lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's own kind, which knows every store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = hadoop(spark, path)
    return files.exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    files, at = hadoop(spark, path)
    files.delete(at, True)


#: Bytes of a table's files for each shuffle partition of the work on them.
FILE_BYTES = 8 << 20


def size_shuffles(spark: SparkSession, path: str, each: int = FILE_BYTES) -> None:
    """From now on, in this session, shuffles have a partition for each ``each`` bytes of the files under ``path``, and never
    fewer than before: what a task holds doesn't grow with the table, and small shuffles are put together by Spark."""
    files, at = hadoop(spark, path)
    name = "spark.sql.shuffle.partitions"
    wanted = -(-files.getContentSummary(at).getLength() // each)
    if wanted > int(spark.conf.get(name)):
        spark.conf.set(name, str(wanted))

"""Annotations that arrive as a stream, merged by key as in the batch job; an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labeling import merge_annotations
from ..sources.readers import read_table, replace_table


def merge_stream(arrivals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of arrivals (the columns of the table) merged into the Parquet table at ``table``, which must
    be there; read it by read_table(). A batch that is repeated after a failure merges to the same rows. The whole table
    is written anew by each batch, so batches should be few and large."""

    def merge(batch: DataFrame, _: int) -> None:
        replace_table(merge_annotations(read_table(batch.sparkSession, table), batch), table)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window of event time and type; rows later than ``late`` behind the watermark are dropped."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")

"""Numbering the rows of a whole table in a declared order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_shared

#: Bits of monotonically_increasing_id() below the partition.
LOCAL = 33


def with_row_number(rows: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """Adds ``name``: start, start + 1, ... in the order of ``order`` (columns, ascending; rows that tie: any order).

    The rows are sorted by ranges, each in a task, and written with their place in the range; the sizes of the ranges, a
    row each, are summed up to where each begins. An empty table stays empty.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[rows[c] for c in rows.columns]).alias("row")
    by = [f"k{i}" for i in range(len(order))]
    keyed = rows.select(row, *[rows[c].alias(k) for c, k in zip(order, by)])
    ranged = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("place"))
    placed = write_shared(ranged).select("row", F.shiftright("place", LOCAL).alias("part"), F.col("place").bitwiseAND((1 << LOCAL) - 1).alias("place"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    begins = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    number = F.col("begin") + F.col("place") + start
    return placed.join(F.broadcast(begins), "part").select("row.*", number.alias(name))

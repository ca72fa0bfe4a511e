"""Sharding by vector bin packing: bytes, tokens and rows balanced together (operator 8).

Groups of equal texts stay together. Largest first, each goes to the shard whose residual capacity has the greatest dot
product with it. A group of over 1 / PARCELS of all bytes, tokens or rows is placed for itself; there are at most
3 * PARCELS of those. Smaller ones are dealt by hash into PARCELS bundles that are placed as one, so what is packed does
not grow with the data. Groups that would fill over HOT of a shard are split.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize

PARCELS, HOT = 12_288, 0.5
#: Chunks of a split group for each shard that it would fill.
CHUNKS = 32
DIMENSIONS = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector. Capacities are equal shares of the totals; a shard without room is taken only if none
    has room. Ties go to the lowest shard."""
    total = vectors.sum(0)
    unit = vectors * shards / np.where(total > 0, total, 1)  # in shares of a shard
    residual, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(unit)), -unit.max(1))):
        v = unit[i]
        score = residual @ v
        fits = (residual >= v - 1e-12).all(1)
        if fits.any():
            score[~fits] = -np.inf
        else:  # near the end: where the fullest dimension is least full
            score = (residual - v).min(1)
        out[i] = int(score.argmax())
        residual[out[i]] -= v
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row for each document: doc_id, size, tokens, text_crc32, shard, slot (0, 1, ... within the shard).

    size is the text's UTF-8 bytes (null: none) plus 8, tokens its words. Equal texts share a shard, but for groups of
    over HOT of a shard, which are split by the hash of doc_id and the written row, so that repeats of one row part as well. Repeated
    rows and null doc_ids get slots of their own; texts are measured whole, however long; an empty table gives no rows. To the driver come the sums of
    bundles and of groups over 1 / PARCELS of the whole, some 5 * PARCELS rows at most.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), count_words(F.col("text")).alias("tokens"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("spread")), "shard-rows")
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    small = [max(total[d], 1) / PARCELS for d in DIMENSIONS]
    large = rows.groupBy("group").agg(*sums).filter(" or ".join(f"{d} > {m!r}" for d, m in zip(DIMENSIONS, small)))
    at, own = PARCELS, []
    for g in sorted(large.collect(), key=lambda g: g["group"]):
        shards_of = max(g[d] * shards / max(total[d], 1) for d in DIMENSIONS)
        chunks = math.ceil(CHUNKS * shards_of) if shards_of > HOT else 1
        parts = math.ceil(g["rows"] / chunks / max(small[-1], 1))  # in which a chunk's rows are numbered
        own.append((g["group"], at, chunks, parts))
        at += chunks
    split = spark.createDataFrame(own, "group long, first long, chunks int, parts int")
    spread = lambda tag, n: F.pmod(F.xxhash64(F.lit(tag), F.col("doc_id"), F.col("spread")), F.col(n))
    dealt = rows.join(F.broadcast(split), "group", "left").withColumns(
        {"parcel": F.coalesce(F.col("first") + spread("chunk", "chunks"), F.pmod("group", F.lit(PARCELS))), "part": F.coalesce(spread("part", "parts"), F.lit(0)).cast("int")}
    )
    table = dealt.groupBy("parcel", "part").agg(*sums).toPandas().sort_values(["parcel", "part"], ignore_index=True)
    parcels = table.groupby("parcel", as_index=False)[list(DIMENSIONS)].sum()
    parcels["shard"] = pack(parcels[list(DIMENSIONS)].to_numpy(float).reshape(-1, len(DIMENSIONS)), shards)
    table = table.merge(parcels[["parcel", "shard"]], on="parcel")
    table["slot0"] = table.groupby("shard")["rows"].cumsum() - table["rows"]
    place = spark.createDataFrame([tuple(map(int, r)) for r in table[["parcel", "part", "shard", "slot0"]].to_numpy()], "parcel long, part int, shard int, slot0 long")
    inside = Window.partitionBy("parcel", "part").orderBy("doc_id", "group")
    numbered = dealt.withColumn("n", F.row_number().over(inside) - 1).join(F.broadcast(place), ["parcel", "part"])
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("n") + F.col("slot0")).cast("long").alias("slot"))

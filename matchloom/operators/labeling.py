"""Choosing, labelling and merging annotations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical, require_columns, seeded_key
from ..sources.shared import exists, shared_folder

KEY = ["pair_left", "pair_right", "labeling_fingerprint"]


def fingerprint(*settings: str):
    """16 hex digits of the sha256 of the settings' JSON in sorted order."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.array(*[F.lit(s) for s in settings]))), 256), 1, 16)


def in_interval(scored: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs whose source_score is in [low, high], each once (canonical; the least score of its rows)."""
    rows = canonical(require_columns(scored, "id1", "id2", "source_score").filter(F.col("source_score").between(low, high)))
    return rows.groupBy(F.col("u").alias("pair_left"), F.col("v").alias("pair_right")).agg(F.min("source_score").alias("source_score"))


def unlabelled(candidates: DataFrame, annotations: DataFrame, fingerprint: str) -> DataFrame:
    done = annotations.filter(F.col("labeling_fingerprint") == fingerprint)
    return candidates.join(done, ["pair_left", "pair_right"], "left_anti")


def select_pairs(scored: DataFrame, annotations: DataFrame, fingerprint: str, low: float, high: float, n: int, seed: int) -> DataFrame:
    """n pairs to label next: in the interval, canonical, not yet labelled under this fingerprint, the first by seeded
    hash. A later call with their annotations goes on with the next."""
    rest = unlabelled(in_interval(scored, low, high), annotations, fingerprint)
    return rest.withColumn("key", seeded_key(seed, "pair_left", "pair_right")).orderBy("key", "pair_left", "pair_right").limit(n).drop("key")


def selection_counters(scored: DataFrame, annotations: DataFrame, fingerprint: str, low: float, high: float, n: int) -> DataFrame:
    """One row: rows, rows in the interval, distinct pairs, already labelled, selected."""
    inside = F.col("source_score").between(low, high)
    rows = scored.agg(F.count("*").alias("input_rows"), F.count_if(inside).alias("interval_rows"))
    done = annotations.filter(F.col("labeling_fingerprint") == fingerprint).select("pair_left", "pair_right").distinct().withColumn("done", F.lit(1))
    pairs = in_interval(scored, low, high).join(done, ["pair_left", "pair_right"], "left").agg(F.count("*").alias("unique_pairs"), F.count("done").alias("already_labelled"))
    both = rows.join(F.broadcast(pairs))  # two tables of one row
    return both.withColumn("selected", F.least(F.lit(n), F.col("unique_pairs") - F.col("already_labelled")))


def merge_annotations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each key, the new before the existing, of several new the one labelled last."""
    rows = existing.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_seq"), F.desc("labeled_at")))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_seq", "_rank")


def content_fingerprint(rows: DataFrame, *settings: str) -> str:
    """32 hex digits that stand for the rows, in any order, and settings: one aggregation over a hash of each row."""
    columns = sorted(rows.columns)
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    h = [F.xxhash64(F.lit(k), line).cast("decimal(20,0)") for k in (0, 1)]
    found = rows.agg(F.count("*").alias("n"), *[F.sum(x).cast("string").alias(f"s{k}") for k, x in enumerate(h)]).first()
    return hashlib.sha256(json.dumps([columns, found["n"], found["s0"], found["s1"], *settings]).encode()).hexdigest()[:32]


def label_rounds(rows: DataFrame, label: Callable[[DataFrame, int], DataFrame], name: str, settings: tuple[str, ...] = (), rounds: int = 3, concurrency: int = 64, least: int = 32) -> tuple[DataFrame, list[Row]]:
    """Labels rows (with row_id) by ``label(rows, concurrency)``, which gives row_id, answer (null: failed); only failed
    rows go to the next round, with half the concurrency down to ``least``. Each round is written to the shared folder
    under ``name`` and a fingerprint of the rows and of the labeller's ``settings``: a restart with the same reads the rounds
    that are whole and labels only what they lack, other rows or settings start anew. row_id must be unique, and each
    answer's row_id one of the round's, once. Returns the answers and a counter row a round."""
    if not rows.groupBy("row_id").count().filter("count > 1 or row_id is null").isEmpty():
        raise ValueError("row_id is null or comes twice")
    spark = rows.sparkSession
    done, todo, told = None, rows, []
    mark = content_fingerprint(rows, *settings)
    for k in range(rounds):
        width = max(least, concurrency >> k)
        path = f"{shared_folder(spark)}/{name}-{mark}-{k}"
        if not exists(spark, f"{path}/_SUCCESS"):  # the mark of a whole table
            label(todo, width).write.mode("overwrite").parquet(path)
        answered = spark.read.parquet(path)
        if answered.count() != answered.select("row_id").distinct().join(todo, "row_id", "left_semi").count():
            raise ValueError("an answer's row_id is unknown or comes twice")
        good = answered.filter("answer is not null")
        counts = answered.agg(F.count("*").alias("rows"), F.count("answer").alias("labelled")).first()
        told.append(Row(round=k, concurrency=width, rows=counts["rows"], labelled=counts["labelled"]))
        done = good if done is None else done.unionByName(good)
        todo = todo.join(good, "row_id", "left_anti")
        if counts["rows"] == counts["labelled"]:
            break
    return done, told

"""Mixing sources to target weights along a time-varying curriculum (operator 3).

Training time runs from 0 to 1. Source s is drawn with weight w * (1 + drift * (2t - 1)); over all time that integrates
to w. Its documents, in a random but fixed order and in up to MAX_REPEATS passes, make up its target of words; inverting
the cumulated demand t + drift * (t * t - t) at a copy's share of the target gives the copy's position in training.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, count_words, materialize, partitions

MAX_REPEATS = 3
#: Weights and drifts of the sources in code point order, repeating.
WEIGHTS, DRIFTS = (1, 2, 3), (-0.5, 0.0, 0.5)
#: Rows of a source summed in one task, about.
ROWS = 2_000


def _source(docs: DataFrame) -> Column:
    """Sorts by code point, null last."""
    return F.when(docs["source"].isNull(), "2").otherwise(F.concat(F.lit("1"), docs["source"]))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, drifts: tuple = DRIFTS, cap: int = MAX_REPEATS) -> DataFrame:
    """To (source_key, source_size), a row a source: weight, drift and target.

    All targets together are all sizes. A target stops at ``cap`` times its source's size and the excess goes to the
    others by weight until none is above: the sources that stop are those of least size for their weight, so one pass
    in that order finds the level at which the rest are filled.
    """
    order = Window.orderBy("source_key")  # a row a source
    rank = F.row_number().over(order) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), rank % len(values) + 1)
    ranked = sources.withColumns({"weight": pick(weights), "drift": pick(drifts)})
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    level = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    level = ranked.withColumn("own_level", level)
    # the first source that its level does not fill beyond the cap, and all after it, share that level
    holds = F.when(F.col("own_level") * F.col("weight") <= cap * F.col("source_size"), F.col("own_level"))
    level = level.withColumn("level", F.coalesce(F.first(holds, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    capped = (cap * F.col("source_size")).cast("double")
    return level.select("source_key", "source_size", "weight", "drift", F.least(capped, F.col("level") * F.col("weight")).alias("target"))


def when_due(share: Column, drift: Column) -> Column:
    """The time t at which t + drift * (t * t - t) is share."""
    a, b = drift, 1 - drift
    root = (F.sqrt(b * b + 4 * a * share) - b) / (2 * a)
    return F.when(a == 0, share).otherwise(root)


def scheduled(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, drifts: tuple = DRIFTS, cap: int = MAX_REPEATS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each document: row (struct of its columns, or of those in ``keep``), size, source_size, target, copies, positions.

    size is the number of words (null text: 0). A source's order is by md5 of seed and doc_id (ties: size). All its
    documents are taken floor(target / source_size) times, and once more those whose middle word comes before what is
    then lacking, so a source's words are within half a document of its target and no document is taken more than
    ``cap`` times. positions has a time in [0, 1] for each copy. A null source is the last; without a doc_id the text's
    md5 stands for it; texts are counted whole, however long; repeated rows count each; documents without words may be taken but add nothing; an empty table gives no rows.

    Sums are by parts of a source's order, so that a source with a third of all rows is spread over tasks.
    """
    # rows without a doc_id are told apart by their texts, or all would be one key
    name = F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(seed), name)).alias("key")
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), count_words(docs["text"]).alias("size"), _source(docs).alias("source_key"), key)
    digits = max(1, math.ceil(math.log(max(docs.count(), 1) / ROWS, 16))) if docs.columns else 1
    part = F.substring("key", 1, digits).alias("part")
    parts = materialize(rows.groupBy("source_key", part).agg(F.sum("size").alias("part_size")), "mix-parts")
    sources = targets(parts.groupBy("source_key").agg(F.sum("part_size").alias("source_size")), weights, drifts, cap)
    so_far = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.select("source_key", "part", F.coalesce(F.sum("part_size").over(so_far), F.lit(0)).alias("part_before")).join(sources, "source_key")
    inside = Window.partitionBy("source_key", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("part", part).withColumn("own_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["source_key", "part"])
    before = F.col("own_before") + F.col("part_before")
    passes = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))
    lacking = F.col("target") - passes * F.col("source_size")
    extra = (2 * before + F.col("size")).cast("double") <= 2 * lacking
    copies = F.least(passes + F.when(extra, 1).otherwise(0), F.lit(cap)).cast("int")
    share = lambda k: F.least(F.try_divide((2 * (k * F.col("source_size") + before) + F.col("size")).cast("double"), 2 * F.col("target")), F.lit(1.0))
    at = lambda k: F.coalesce(when_due(share(k), F.col("drift")), F.lit(1.0))
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"), F.slice(F.array(*[at(F.lit(k)) for k in range(cap)]), F.lit(1), copies).alias("positions"))


def ordered_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of scheduled() with copy (0, 1, ...) and position: one for each copy, sorted by position over all partitions. A
    document that isn't taken has one with nulls; these come first, by doc_id, so that no range holds them all."""
    copies = scheduled(docs, **options).select("*", F.posexplode_outer("positions").alias("copy", "position"))
    n = partitions(docs.sparkSession)
    return copies.repartitionByRange(n, "position", F.col("row.doc_id")).sortWithinPartitions("position", "row.doc_id")


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """scheduled() in training order: every copy is placed, and a document's row stands where its first copy does."""
    names = ("seed", "weights", "drifts", "cap")
    return ordered_copies(docs, **dict(zip(names, args)), **options).filter("copy IS NULL OR copy = 0").drop("copy", "position")


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy, sorted by position over all partitions."""
    return ordered_copies(docs, **options).filter("copy IS NOT NULL").select("row.*")


#: DuckDB SQL for the query op3_mixing.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS source_key,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key
  FROM documents
), sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1
), ranked AS (SELECT *, (row_number() OVER (ORDER BY source_key) - 1) % 3 + 1e0 AS weight FROM sources
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM ranked
), level AS (SELECT coalesce(arg_min(own_level, source_size / weight), 0) AS level FROM levels WHERE own_level * weight <= 3 * source_size
), targets AS (
  SELECT source_key, source_size, (weight - 2) * 0.5e0 AS drift, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM ranked, level
), placed AS (
  SELECT s.*, t.source_size, t.target, t.drift, coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(floor(CASE WHEN source_size > 0 THEN target / source_size END), 0) AS passes
  FROM sized s JOIN targets t USING (source_key)
), taken AS (
  SELECT *, CAST(least(passes + CASE WHEN CAST(2 * before + size AS DOUBLE) <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies,
    least(CASE WHEN target > 0 THEN CAST(2 * before + size AS DOUBLE) / (2 * target) END, 1e0) AS share FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, CAST(copies AS INTEGER) AS copies,
  CASE WHEN copies > 0 THEN round(coalesce(CASE WHEN drift = 0 THEN share ELSE (sqrt((1 - drift) * (1 - drift) + 4 * drift * share) - (1 - drift)) / (2 * drift) END, 1e0), 6) END AS position
FROM taken
"""

"""Leakage-safe splits into training and validation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import TWO_48, canonical
from ..sources.shared import write_shared
from .graph import connected_components
from .labels import check


def with_category(items: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with the category of their left item; an id twice in items is an error."""
    twice = items.groupBy("id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("items has an id twice")
    return matches.join(items.select(F.col("id").alias("id1"), "category"), "id1", "left")


def validate(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Two pairs at least, no null ids, all ids known, both classes."""
    check(matches, null_id=F.col("id1").isNull() | F.col("id2").isNull(), bad_target=~F.col("target").isin(0, 1))
    about = matches.agg(F.count("*").alias("n"), F.countDistinct("target").alias("classes")).first()
    if about["n"] < 2 or about["classes"] < 2:
        raise ValueError("a split needs two pairs and both classes")
    if not unknown_ids(items, matches).isEmpty():
        raise ValueError("matches has unknown ids")
    return matches


def pair_ids(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()


def unknown_ids(items: DataFrame, matches: DataFrame) -> DataFrame:
    return pair_ids(matches).join(items.select("id"), "id", "left_anti")


def groups(matches: DataFrame, scope: str) -> DataFrame:
    """Adds grp, which must not be torn: the pair either way round ("pair"), its component ("item"), the row ("none")."""
    rows = canonical(matches)
    if scope == "item":
        found = connected_components(matches).withColumnRenamed("component", "grp")
        return rows.join(found, rows.u == found.node).drop("node", "u", "v").withColumn("grp", F.col("grp").cast("string"))
    key = F.concat_ws("|", "u", "v") if scope == "pair" else F.concat_ws("|", *[F.col(c).cast("string") for c in matches.columns])
    return rows.withColumn("grp", key).drop("u", "v")


def eligible_strata(rows: DataFrame) -> DataFrame:
    """category, target, eligible: strata with two groups at least can be on both sides."""
    return rows.groupBy("category", "target").agg((F.countDistinct("grp") >= 2).alias("eligible"))


def stratum_diagnostics(rows: DataFrame, held_out: Column, fraction: float) -> DataFrame:
    """A row for each stratum: n, n_validation, validation_rate, deviation from ``fraction``."""
    n, v = F.count("*"), F.count_if(held_out)
    return rows.groupBy("category", "target").agg(n.alias("n"), v.alias("n_validation"), (v / n).alias("validation_rate"), F.abs(v / n - fraction).alias("deviation"))


def split_quality(rows: DataFrame, held_out: Column, fraction: float) -> DataFrame:
    """One row over all strata: strata, those that could be on both sides and aren't, the greatest deviation from
    ``fraction`` among those that could."""
    parts = stratum_diagnostics(rows, held_out, fraction).join(eligible_strata(rows), ["category", "target"])
    one_sided = (F.col("n_validation") == 0) | (F.col("n_validation") == F.col("n"))
    return parts.agg(F.count("*").alias("strata"), F.count_if(F.col("eligible") & one_sided).alias("missing_strata"), F.max(F.when(F.col("eligible"), F.col("deviation"))).alias("max_deviation"))


def select_rows(rows: DataFrame, chosen: DataFrame, key: str = "pair_row") -> DataFrame:
    """The rows whose key is in ``chosen``, sorted by key."""
    return rows.join(chosen.select(key), key, "left_semi").orderBy(key)


@dataclass(frozen=True)
class Split:
    train: DataFrame
    validation: DataFrame
    seed: int
    missing_strata: int
    distribution_error: float
    size_error: float


def candidate_scores(rows: DataFrame, seeds: list[int], fraction: float) -> DataFrame:
    """seed, missing, distribution_error, size_error of each candidate split, all in one job.

    A candidate holds out the groups whose seeded hash is below ``fraction``; rows (grp, category, target) are first
    counted by group and stratum, so what is multiplied by the seeds are counts.
    """
    counts = rows.groupBy("grp", "category", "target").agg(F.count("*").alias("n"))
    tried = counts.withColumn("seed", F.explode(F.array(*[F.lit(str(s)) for s in seeds])))  # as text, which the hash takes
    out = held_out(F.col("seed"), F.col("grp"), fraction)
    strata = tried.groupBy("seed", "category", "target").agg(F.sum("n").alias("n"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("v"), (F.count("*") >= 2).alias("eligible"))
    missing = F.count_if(F.col("eligible") & ((F.col("v") == 0) | (F.col("v") == F.col("n"))))
    total = F.sum("n")
    return strata.groupBy(F.col("seed").cast("int").alias("seed")).agg(
        missing.alias("missing"), (F.sum(F.abs(F.col("v") - F.col("n") * fraction)) / total).alias("distribution_error"), F.abs(F.sum("v") / total - fraction).alias("size_error")
    )


def held_out(seed: Column, key: Column, fraction: float) -> Column:
    """uniform(seeded_key(seed, key)) <= fraction, by the 12 hex digits of the key, whose order as text is that of the number:
    a key of 48 bits and its share of 2 ** 48 are exact as doubles, so the greatest key that passes is known."""
    digits = F.substring(F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string"))), 1, 12)
    last = math.floor(min(max(fraction, 0.0), 1.0) * TWO_48) - 1
    return digits <= f"{last:012x}" if last >= 0 else F.lit(False)


def search_split(items: DataFrame, matches: DataFrame, fraction: float = 0.2, candidates: int = 128, seed: int = 42, scope: str = "pair") -> Split:
    """The candidate with the fewest eligible strata missing on a side, then the least distribution error, then the
    least size error. Both classes must be on both sides."""
    rows = write_shared(with_category(items, groups(matches, scope)))  # read for the counts, the classes and each side
    best = candidate_scores(rows, list(range(seed, seed + candidates)), fraction).orderBy("missing", F.round("distribution_error", 12), F.round("size_error", 12), "seed").first()
    held = held_out(F.lit(best["seed"]), F.col("grp"), fraction)
    classes = [r["held"] for r in rows.select(held.alias("held"), "target").distinct().collect()]
    if min(classes.count(True), classes.count(False)) < 2:
        raise ValueError("a side of the split lacks a class")
    train, validation = rows.filter(~held).drop("grp", "category"), rows.filter(held).drop("grp", "category")
    return Split(train, validation, best["seed"], best["missing"], best["distribution_error"], best["size_error"])


def leaking_pairs(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Pairs, each once, that are on both sides: an aggregate by pair, which sorts neither side."""
    sided = lambda rows, held: canonical(rows).select("u", "v", F.lit(held).alias("held"))
    both = sided(train, False).unionByName(sided(validation, True)).groupBy("u", "v").agg(F.min("held").alias("a"), F.max("held").alias("b"))
    return both.filter("a <> b").select("u", "v")


def leaking_items(train: DataFrame, validation: DataFrame) -> DataFrame:
    return pair_ids(train).intersect(pair_ids(validation))


def check_leakage(train: DataFrame, validation: DataFrame, scope: str) -> None:
    """An error if the scope ("none", "pair", "item") is broken."""
    found = {"none": None, "pair": leaking_pairs, "item": leaking_items}[scope]
    if found and not found(train, validation).isEmpty():
        raise ValueError(f"{scope} leakage between training and validation")

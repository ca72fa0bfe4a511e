"""Whole jobs made of the operators: training sets from several label sources, and prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import attributes, normalize_text
from ..functions.units import normalize_attributes
from ..operators import graph, labels, pairs, split
from ..operators.models import PairScorer
from ..sources.readers import inference_inputs


@dataclass(frozen=True)
class Source:
    """How one label source is prepared. kind: "label", "probability" or "votes"."""

    name: str
    kind: str = "label"
    weight: float = 1.0
    negative: float = 0.5
    positive: float = 0.5
    total_votes: int = 9
    drop: bool = True
    soft: bool = False
    transitivity: dict | None = None
    confidence_floor: float | None = None
    confidence_power: float = 1.0
    max_rows: int | None = None
    sampling: str = "balanced"

    def __post_init__(self) -> None:
        if self.kind not in ("label", "probability", "votes"):
            raise ValueError(f"source {self.name}: unknown kind {self.kind}")
        if self.weight <= 0 or self.negative > self.positive:
            raise ValueError(f"source {self.name}: weight must be positive and negative <= positive")


@dataclass(frozen=True)
class Recipe:
    """Sources in order of priority; one of them gives the validation set."""

    sources: tuple[Source, ...]
    validation_source: str
    fraction: float = 0.2
    candidates: int = 128
    seed: int = 42
    scope: str = "pair"


def prepare(source: Source, matches: DataFrame) -> DataFrame:
    labels.validate_matches(matches)
    if source.kind == "label":
        return labels.hard_labels(matches)
    if source.kind == "probability":
        return labels.probability_labels(matches, source.negative, source.positive, source.drop, source.soft)
    return labels.vote_labels(labels.steps_of_votes(matches, source.total_votes), source.total_votes, int(source.negative), int(source.positive), source.drop, source.soft)


def finalize(source: Source, rows: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """Graph weights, confidence weights and the sample of a source."""
    rows = graph.transitivity_weights(rows, **source.transitivity) if source.transitivity is not None else graph.constant_weights(rows)
    rows = labels.with_weights(rows, source.weight, source.confidence_floor, source.confidence_power)
    if source.max_rows is not None and rows.count() > source.max_rows:
        rows = labels.stratified_sample(split.with_category(items, rows), ["category", "target"], ["id1", "id2"], source.max_rows, seed, source.sampling).drop("category")
    return rows.withColumn("data_source", F.lit(source.name))


def training_set(recipe: Recipe, matches: dict[str, DataFrame], items: DataFrame) -> split.Split:
    """Labels of all sources, overlaps resolved by priority, weighted and sampled; validation from one source alone,
    with weight 1; training from the rest of it and the others, without what would leak."""
    prepared = {s.name: prepare(s, matches[s.name]) for s in recipe.sources}
    resolved = labels.resolve_overlaps(prepared, [s.name for s in recipe.sources]).drop("u", "v", "had_overlap", "had_conflict")
    parts = {s.name: finalize(s, resolved.filter(F.col("data_source") == s.name).select(*prepared[s.name].columns), items, recipe.seed) for s in recipe.sources}
    own = parts[recipe.validation_source]
    best = split.search_split(items, own, recipe.fraction, recipe.candidates, recipe.seed, recipe.scope)
    validation = best.validation.withColumn("sample_weight", F.lit(1.0))
    train = best.train
    for name, rows in parts.items():
        if name != recipe.validation_source:
            train = train.unionByName(rows, allowMissingColumns=True)
    if recipe.scope == "item":
        held = split.pair_ids(validation)
        train = train.join(held.withColumnRenamed("id", "id1"), "id1", "left_anti").join(held.withColumnRenamed("id", "id2"), "id2", "left_anti")
    split.check_leakage(train, validation, recipe.scope)
    return split.Split(train, validation, best.seed, best.missing_strata, best.distribution_error, best.size_error)


@dataclass(frozen=True)
class BaseSplits:
    """Training, validation and, if asked for, stacking rows of one source, and the quality of each split (see
    split.split_quality): a row for each of them."""

    train: DataFrame
    validation: DataFrame
    stacking: DataFrame | None
    quality: DataFrame


def base_splits(items: DataFrame, matches: DataFrame, validation_fraction: float = 0.2, stacking_fraction: float | None = None, candidates: int = 128, seed: int = 42, scope: str = "pair") -> BaseSplits:
    """One source's labels in two or three parts that share no group of the scope. Validation rows have weight 1. The stacking
    part is ``stacking_fraction`` of all rows: it is cut from what validation leaves, so by a fraction of that, with the
    next seed."""
    if stacking_fraction is not None and not 0 < stacking_fraction < 1 - validation_fraction:
        raise ValueError("stacking and validation together must leave rows to train on")
    rows = labels.with_defaults(split.validate(items, labels.hard_labels(matches)))
    first = split.search_split(items, rows, validation_fraction, candidates, seed, scope)
    train, stacking, told = first.train, None, [("validation", first, validation_fraction)]
    if stacking_fraction is not None:
        relative = stacking_fraction / (1 - validation_fraction)
        second = split.search_split(items, train, relative, candidates, seed + 1, scope)
        train, stacking = second.train, second.validation
        told.append(("stacking", second, relative))
    parts = [p for p in (train, first.validation, stacking) if p is not None]
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            split.check_leakage(a, b, scope)
    spark = items.sparkSession
    quality = spark.createDataFrame([(name, s.seed, float(f), s.missing_strata, float(s.distribution_error), float(s.size_error)) for name, s, f in told], "part string, seed long, fraction double, missing_strata long, distribution_error double, size_error double")
    return BaseSplits(train, first.validation.withColumn("sample_weight", F.lit(1.0)), stacking, quality)


def predefined_splits(items: DataFrame, train: DataFrame, validation: DataFrame, fraction: float | None = None, scope: str = "pair") -> BaseSplits:
    """A split that is given: both parts checked, no leakage in the scope, validation rows with weight 1, and how well the
    strata are spread over the parts (against ``fraction`` or, without it, validation's own share)."""
    parts = [labels.with_defaults(split.validate(items, labels.hard_labels(p))) for p in (train, validation)]
    split.check_leakage(*parts, scope)
    n, v = (p.count() for p in parts)
    share = v / (n + v) if fraction is None else fraction
    both = parts[0].withColumn("_held", F.lit(False)).unionByName(parts[1].withColumn("_held", F.lit(True)), allowMissingColumns=True)
    rows = split.with_category(items, split.groups(both, "pair" if scope == "none" else scope))
    told = split.split_quality(rows, F.col("_held"), share)
    quality = told.select(F.lit("validation").alias("part"), F.lit(None).cast("long").alias("seed"), F.lit(float(share)).alias("fraction"), F.col("missing_strata").cast("long").alias("missing_strata"), F.col("max_deviation").alias("distribution_error"), F.lit(abs(v / (n + v) - share)).alias("size_error"))
    return BaseSplits(parts[0], parts[1].withColumn("sample_weight", F.lit(1.0)), None, quality)


#: Recipes by name: what makes the training set of that kind.
RECIPES = {"base": base_splits, "mixed": training_set, "predefined": predefined_splits}


def recipe(name: str):
    """The function that makes a training set, by its name."""
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name}: one of {', '.join(sorted(RECIPES))}")
    return RECIPES[name]


def enrich(items: DataFrame) -> DataFrame:
    """Items with attributes parsed from JSON and in normal form: names normalised, measures in target units."""
    parsed = items.withColumn("attributes", F.coalesce(normalize_attributes(attributes(F.col("attributes"))), F.array().cast("array<struct<k:string,v:string>>")))
    return parsed.withColumn("name", normalize_text(F.col("name")))


def predict_pairs(items: DataFrame, matches: DataFrame, scorer: PairScorer) -> DataFrame:
    """pair_row, id1, id2, predict in the order of pair_row: inputs checked, the referred items enriched once each,
    features once a pair, the mean where a scorer gives several rows a pair."""
    used, rows = inference_inputs(items, matches)
    rows = pairs.with_pair_row(rows, "id1", "id2") if "pair_row" not in rows.columns else rows
    scored = scorer(pairs.all_features(rows, enrich(used)))
    return scored.groupBy("pair_row", "id1", "id2").agg(F.avg("predict").alias("predict")).orderBy("pair_row")

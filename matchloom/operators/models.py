"""Scorers and the ways to combine them. Neural scorers plug in as any callable from pairs to a predict column."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import require_columns, seeded_key
from ..functions.similarity import logit, sigmoid
from ..functions.vectors import max_products, min_max_pool
from ..sources.shared import write_shared

#: A scorer adds a finite predict in [0, 1] to each row.
PairScorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: dict[str, float], bias: float) -> PairScorer:
    """A scorer from fixed weights of feature columns: the deterministic stand-in for a learned model."""
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + w * F.col(name)
    return lambda rows: require_columns(rows, *weights).withColumn("predict", sigmoid(z))


def cascade(rows: DataFrame, fast: Column, main: PairScorer, negative: float, positive: float, key: str = "pair_row") -> DataFrame:
    """predict is the fast score where that is certain, else the main scorer's. Rows with negative < fast < positive
    alone reach the main scorer: they are a branch of the plan of their own, joined back by key."""
    scored = rows.withColumn("fast", fast)
    unsure = main(scored.filter((F.col("fast") > negative) & (F.col("fast") < positive))).select(key, F.col("predict").alias("main"))
    return scored.join(unsure, key, "left").withColumn("predict", F.coalesce("main", "fast")).drop("main")


def margins(z0: Column, z1: Column | None = None) -> tuple[Column, Column]:
    """(probability, margin) of one logit or two."""
    margin = z0 if z1 is None else z1 - z0
    return sigmoid(margin), margin


def stacking_features(features: DataFrame, out_of_sample: DataFrame, key: str = "pair_row") -> DataFrame:
    """features with the logit margin of an out-of-sample prediction; each row must have one."""
    p = F.least(F.greatest(F.col("predict"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return features.join(out_of_sample.select(key, logit(p).alias("oos_margin")), key)


def with_fold(rows: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold (0 to folds - 1), by a seeded hash of the group: rows of a group share one."""
    if folds < 2:
        raise ValueError("two folds at least")
    return rows.withColumn("fold", (seeded_key(seed, group) % folds).cast("int"))


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], PairScorer], group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold and predict, each scored by a scorer that ``fit`` made of the other folds' rows: none of its group was
    among them. ``fit`` is called once a fold and may run jobs of its own; its scorer gives a row for each that it gets. The
    rows are written once with their fold, for each fold reads them all."""
    return by_fold(write_shared(with_fold(rows, group, folds, seed)), fit, folds)


def by_fold(dealt: DataFrame, fit: Callable[[DataFrame], PairScorer], folds: int = 5) -> DataFrame:
    """out_of_fold() of rows that have their fold, which are read twice and more a fold: a table. Each fold is a branch of one
    plan."""
    parts = [fit(dealt.filter(F.col("fold") != k))(dealt.filter(F.col("fold") == k)).select(*dealt.columns, "predict") for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rate_scorer(rows: DataFrame, by: str, prior: float = 1.0) -> PairScorer:
    """The share of target 1 among rows of a column's value, smoothed by ``prior`` rows of the mean: the simplest scorer that
    learns. Values it hasn't seen get the mean; without rows all get 0.5. The rates are written, in one pass over the rows:
    the mean is theirs, and Spark sees by their size how to join them."""
    target = F.col("target").cast("double")
    rates = write_shared(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(target).alias("_sum"), F.count("*").alias("_n"), F.count(target).alias("_known")))
    mean = rates.agg(F.coalesce(F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0)), F.lit(0.5)).alias("mean"))

    def score(new: DataFrame) -> DataFrame:
        found = new.join(rates, new[by].eqNullSafe(F.col("_by")), "left").join(F.broadcast(mean))  # a table of one row
        predict = (F.coalesce("_sum", F.lit(0.0)) + prior * F.col("mean")) / (F.coalesce("_n", F.lit(0)) + prior)
        return found.select(*new.columns, predict.alias("predict"))

    return score


def stacked_margins(rows: DataFrame, fit: Callable[[DataFrame], PairScorer], group: str, key: str = "pair_row", folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with oos_margin, the logit margin of their out-of-fold prediction."""
    return stacking_features(rows, out_of_fold(rows, fit, group, folds, seed), key)


def sample_space(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n settings of a space, drawn by seed. An entry is ("choice", value, ...), ("uniform", low, high), ("log", low, high) or
    ("int", low, high), both ends included. The same space and seed give the same settings, in any order of entries."""
    rng, out = random.Random(seed), []
    draw = {
        "choice": lambda *values: rng.choice(values), "uniform": rng.uniform, "int": rng.randint,
        "log": lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high))),
    }
    if unknown := sorted({kind for kind, *_ in space.values()} - draw.keys()):
        raise ValueError(f"unknown kinds of entries: {', '.join(unknown)}")
    for _ in range(n):
        out.append({name: draw[space[name][0]](*space[name][1:]) for name in sorted(space)})
    return out


def search_parameters(train: DataFrame, validation: DataFrame, fit: Callable[..., PairScorer], space: dict[str, tuple], loss: Callable[[DataFrame], Column], n: int = 20, seed: int = 42, at_once: int = 4) -> list[tuple[float, dict]]:
    """(loss, setting) of n sampled settings, the least loss first, ties as drawn. Both parts are written once, ``at_once``
    fits run side by side, each over the same written rows; ``loss`` is an aggregate over rows with predict."""
    train, validation = write_shared(train), write_shared(validation)
    settings = sample_space(space, n, seed)

    def tried(setting: dict) -> float:
        found = fit(train, **setting)(validation).agg(loss(F.col("predict")).alias("loss")).first()["loss"]
        return math.inf if found is None or found != found else float(found)

    with ThreadPoolExecutor(at_once) as pool:
        losses = list(pool.map(tried, settings))
    order = sorted(range(len(settings)), key=lambda i: (losses[i], i))
    return [(losses[i], settings[i]) for i in order]


def _assembled(numeric: list[str], category: str | None) -> list:
    stages = [StringIndexer(inputCol=category, outputCol="_category", handleInvalid="keep")] if category else []
    return [*stages, VectorAssembler(inputCols=[*numeric, *(["_category"] if category else [])], outputCol="features")]


def train_boosting(rows: DataFrame, numeric: list[str], category: str | None = "category", trees: int = 30, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on target with sample_weight; stops early on rows with is_validation, if there."""
    options = {"validationIndicatorCol": "is_validation"} if "is_validation" in rows.columns else {}
    bins = {"maxBins": max(32, rows.select(category).distinct().count() + 1)} if category else {}
    model = GBTClassifier(labelCol="target", weightCol="sample_weight", maxIter=trees, maxDepth=depth, seed=seed, **bins, **options)
    return Pipeline(stages=[*_assembled(numeric, category), model]).fit(rows)


def train_mlp(rows: DataFrame, numeric: list[str], hidden: int = 32, seed: int = 42) -> PipelineModel:
    """Standardised features, one hidden layer: the head of fusion and max-pooling models."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = MultilayerPerceptronClassifier(labelCol="target", featuresCol="scaled", layers=[len(numeric), hidden, 2], seed=seed, maxIter=60)
    return Pipeline(stages=[*_assembled(numeric, None), scaler, model]).fit(rows)


def predict(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with predict, the probability of class 1."""
    return model.transform(rows).withColumn("predict", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "predict")


def train_token_vectors(tokens: DataFrame, dimensions: int = 16, seed: int = 42, partitions: int = 4, passes: int = 4, least: int = 2) -> DataFrame:
    """word, vector of Word2Vec over a column of token arrays, trained in ``partitions`` parts whose vectors are averaged after
    each pass; words seen under ``least`` times have none. Words without a vector get one by token_vectors()."""
    model = Word2Vec(inputCol="tokens", outputCol="v", vectorSize=dimensions, minCount=least, seed=seed, numPartitions=partitions, maxIter=passes).fit(tokens)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


#: Lengths of the character n-grams of a word between < and >, and how many buckets they are hashed to.
GRAMS, BUCKETS = (2, 3, 4, 5), 1 << 20


def _buckets(word: Column) -> Column:
    """The distinct buckets of a word's n-grams."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - n + 1, F.lit(1))), lambda i: marked.substr(i, F.lit(n)))
    return F.array_distinct(F.transform(F.concat(*[of(n) for n in GRAMS]), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS))))


def gram_vectors(words: DataFrame) -> DataFrame:
    """bucket, vector, words: the mean vector of the words that have an n-gram of the bucket, and their number. At most BUCKETS
    rows, summed in part before the shuffle."""
    parts = words.select(F.explode(_buckets(F.col("word"))).alias("bucket"), array_to_vector("vector").alias("v"))
    found = parts.groupBy("bucket").agg(Summarizer.mean(F.col("v")).alias("v"), F.count("*").alias("words"))
    return found.select("bucket", vector_to_array("v").alias("vector"), "words")


def token_vectors(asked: DataFrame, words: DataFrame, grams: DataFrame, dimensions: int = 16) -> DataFrame:
    """word, vector for each distinct word of ``asked``: its own or, if it has none, the mean of its n-grams' weighted by one
    over their words, so that those that few words share count most; zeros without a known n-gram. A null word goes."""
    asked = asked.select("word").filter(F.col("word").isNotNull()).distinct()
    unseen = asked.join(words, "word", "left_anti")
    known = unseen.select("word", F.explode(_buckets(F.col("word"))).alias("bucket")).join(grams, "bucket")
    made = known.groupBy("word").agg(Summarizer.mean(array_to_vector("vector"), 1.0 / F.col("words")).alias("v")).select("word", vector_to_array("v").alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    new = unseen.join(made, "word", "left").select("word", F.coalesce("vector", zeros).alias("vector"))
    return asked.join(words, "word").select("word", "vector").unionByName(new)


def max_pool_features(pairs: DataFrame, cards: DataFrame, vectors: DataFrame, dimensions: int = 16, key: str = "item_id") -> DataFrame:
    """pairs (id1, id2) with p0, p1, ...: by dimension the greatest product of a value between the least and the greatest of one
    card's token vectors and one of the other's. ``cards`` has tokens by key; a card without tokens, or unknown, counts as
    zeros. Pooled by dimension with partial aggregation, so a long card isn't gathered as rows of vectors."""
    words = cards.select(key, F.explode("tokens").alias("word")).distinct().join(vectors, "word")
    pooled = min_max_pool(words, key, "vector")
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    out = pairs
    for side in ("1", "2"):
        one = pooled.select(F.col(key).alias(f"id{side}"), F.col("low").alias(f"_low{side}"), F.col("high").alias(f"_high{side}"))
        out = out.join(one, f"id{side}", "left")
    best = max_products(*[F.coalesce(c, zeros) for c in ("_low1", "_high1", "_low2", "_high2")])
    out = out.withColumn("_best", best)
    return out.select(*pairs.columns, *[F.get("_best", F.lit(i)).alias(f"p{i}") for i in range(dimensions)])

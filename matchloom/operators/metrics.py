"""Evaluation: precision-recall and ROC areas, losses, agreement, importance, benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_precision(scores: DataFrame, *groups: str) -> DataFrame:
    """groups, n, positives, average_precision: sum over falling thresholds of gained recall * precision, equal scores
    as one step. Null where a group has no positive. Scores are first counted, so equal ones take one row."""
    steps = scores.groupBy(*groups, "predict").agg(F.count("*").alias("n"), F.sum("target").cast("long").alias("p"))
    w = Window.partitionBy(*groups).orderBy(F.desc("predict")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("n").over(w)})
    gain = F.sum(F.col("p") * (F.col("tp") / F.col("seen")))
    return curve.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.try_divide(gain, F.sum("p")).alias("average_precision"))


def macro_average_precision(scores: DataFrame, group: str = "category", skip_single_class: bool = True) -> DataFrame:
    """Mean average precision over groups, and how many: without those of one class or, with skip_single_class off, a
    group without positives as 0."""
    each = average_precision(scores, group)
    if skip_single_class:
        each = each.filter("positives > 0 and positives < n")
    return each.agg(F.avg(F.coalesce("average_precision", F.lit(0.0))).alias("macro_pr_auc"), F.count("*").alias("groups"))


def classification_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, precision, recall, f1 at ``threshold`` (0 where undefined), pr_auc, roc_auc (rank sum with
    mean ranks of ties)."""
    yes, real = F.col("predict") >= threshold, F.col("target") == 1
    counts = scores.agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))
    steps = scores.groupBy("predict").agg(F.count("*").alias("n"), F.sum("target").cast("long").alias("p"))
    below = Window.orderBy("predict").rowsBetween(Window.unboundedPreceding, -1)
    ranked = steps.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum("n").alias("all"))
    roc = sums.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("all") - F.col("pos"))).alias("roc_auc"))
    zero = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    base = counts.select(zero(tp + tn, tp + fp + fn + tn).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))
    pr = average_precision(scores).select(F.col("average_precision").alias("pr_auc"))
    return base.join(F.broadcast(pr)).join(F.broadcast(roc))  # three tables of one row


def class_weights(rows: DataFrame) -> DataFrame:
    """Of soft labels y and weights w: W / (2 * sum w (1 - y)) and W / (2 * sum w y)."""
    y, w = F.col("training_target"), F.col("sample_weight")
    total = F.sum(w)
    return rows.agg(F.try_divide(total, 2 * F.sum(w * (1 - y))).alias("weight_0"), F.try_divide(total, 2 * F.sum(w * y)).alias("weight_1"))


def weighted_bce(rows: DataFrame, weight_0: float = 1.0, weight_1: float = 1.0) -> DataFrame:
    """Weighted mean of binary cross-entropy of logits with soft labels and class weights, from log1p(exp(-|x|))."""
    x, y, w = F.col("logit"), F.col("training_target"), F.col("sample_weight")
    plus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # ln(1 + e^x)
    loss = weight_1 * y * (plus - x) + weight_0 * (1 - y) * plus
    return rows.agg((F.sum(w * loss) / F.sum(w)).alias("loss"))


def agreement(left: DataFrame, right: DataFrame, key: list[str], gate: float = 1e-3) -> DataFrame:
    """One row: mean and greatest difference of two predictions, share of other classes, and whether they agree."""
    d = F.abs(F.col("l.predict") - F.col("r.predict"))
    other = (F.col("l.predict") >= 0.5) != (F.col("r.predict") >= 0.5)
    both = left.alias("l").join(right.alias("r"), key)
    out = both.agg(F.avg(d).alias("mean_difference"), F.max(d).alias("max_difference"), F.avg(other.cast("double")).alias("disagreement"))
    return out.withColumn("equivalent", (F.col("max_difference") <= gate) & (F.col("disagreement") == 0))


def mean_over_copies(scores: DataFrame, key: str = "pair_row") -> DataFrame:
    return scores.groupBy(key).agg(F.avg("predict").alias("predict"))


def attribute_importance(scored: DataFrame, min_occurrences: int = 30) -> DataFrame:
    """Importance and priority of attributes, globally and by category, in one pass with grouping sets.

    scored: category, attribute, score (null: not scored), tokens, truncated. A category's attribute with fewer scored
    occurrences than ``min_occurrences`` takes the global mean, else 1.0; priority is its rank by importance, then name.
    """
    rows = scored.groupingSets([["category", "attribute"], ["attribute"]], "category", "attribute").agg(
        F.grouping("category").alias("is_global"), F.count("*").alias("occurrences"), F.count("score").alias("scored"), F.avg("score").alias("mean_score"),
        F.avg("tokens").alias("mean_tokens"), F.avg(F.col("truncated").cast("double")).alias("truncated_fraction"),
    )
    every = rows.filter("is_global = 1").select("attribute", F.col("mean_score").alias("global_score"), F.col("scored").alias("global_scored"))
    own = F.when(F.col("scored") >= min_occurrences, F.col("mean_score"))
    shared = F.when(F.col("global_scored") >= min_occurrences, F.col("global_score"))
    found = rows.join(every, "attribute").withColumns(
        {
            "scope": F.when(F.col("is_global") == 1, "global").otherwise("category"),
            "importance": F.coalesce(own, shared, F.lit(1.0)),
            "origin": F.when(own.isNotNull(), "own").when(shared.isNotNull(), "global").otherwise("default"),
        }
    )
    order = Window.partitionBy("scope", "category").orderBy(F.desc(F.round("importance", 9)), "attribute")
    return found.withColumn("priority", F.row_number().over(order)).drop("is_global", "global_score", "global_scored")


def benchmark_aggregates(runs: DataFrame, reference: str) -> DataFrame:
    """test, runs, mean, std (population), wins: over seeds, and against the reference test's run of the same seed."""
    base = runs.filter(F.col("test") == reference).select("seed", F.col("metric").alias("reference_metric"))
    paired = runs.join(base, "seed", "left")
    return paired.groupBy("test").agg(F.count("*").alias("runs"), F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("std"), F.count_if(F.col("metric") > F.col("reference_metric")).alias("wins"))


def pair_set_hash(matches: DataFrame, digits: int = 4) -> DataFrame:
    """One row: sha256 over the set of pairs, whatever their order and sides. Ids compare as text.

    A tree of hashes: the leaves are the pairs whose md5 starts with the same ``digits`` hex digits, sorted; above them
    digests are hashed two digits at a time. With 4 digits a leaf is a 65,536th of the pairs, more of them need more
    digits, and with other digits a set has another hash.
    """
    a, b = F.col("id1").cast("string"), F.col("id2").cast("string")
    lines = matches.select(F.concat_ws(",", F.least(a, b), F.greatest(a, b)).alias("line")).withColumn("at", F.substring(F.md5("line"), 1, digits))
    hashed = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    level = lines.groupBy("at").agg(hashed(F.sort_array(F.collect_list("line"))).alias("digest"))
    for n in [*range(digits - 2, 0, -2), 0]:
        level = level.groupBy(F.substring("at", 1, n).alias("at")).agg(hashed(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])).alias("digest"))
    return level.select(F.col("digest").alias("pair_set_hash"))


def source_summary(rows: DataFrame) -> DataFrame:
    """A row for each data_source: rows, mean weight and multiplier, least multiplier, shares of downweighted and
    violating rows, positives."""
    m = F.col("weight_multiplier")
    return rows.groupBy("data_source").agg(
        F.count("*").alias("rows"), F.avg("sample_weight").alias("mean_weight"), F.avg(m).alias("mean_multiplier"), F.min(m).alias("min_multiplier"), F.avg((m < 1).cast("double")).alias("downweighted_fraction"),
        F.avg((F.col("transitivity_violations") > 0).cast("double")).alias("violating_fraction"), F.count_if(F.col("target") == 1).alias("positives"),
    )


def vote_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("data_source", "target", "annotation_votes").agg(F.count("*").alias("n"))


def length_statistics(rows: DataFrame, length: str, over: tuple[int, ...] = (128, 256, 512)) -> DataFrame:
    """One row: count, percentiles 50, 90, 99, 99.9 (interpolated), greatest, share above each limit."""
    percentile = F.percentile(length, [0.5, 0.9, 0.99, 0.999])
    out = rows.agg(F.count("*").alias("n"), percentile.alias("p"), F.max(length).alias("longest"), *[F.avg((F.col(length) > k).cast("double")).alias(f"over_{k}") for k in over])
    return out.select("n", *[F.get("p", F.lit(i)).alias(f"p{n}") for i, n in enumerate(("50", "90", "99", "99_9"))], "longest", *[f"over_{k}" for k in over])


def longest(rows: DataFrame, length: str, key: str, k: int = 20) -> DataFrame:
    """The k longest rows, ties by key: a top-k, so no task sorts all."""
    return rows.orderBy(F.desc(length), key).limit(k)


def length_limit(rows: DataFrame, length: str, quantile: float, multiple: int = 8, cap: int = 512) -> Column | DataFrame:
    """One row: the length at the upper ``quantile`` of a distribution, rounded up to a multiple, at most ``cap``."""
    counts = rows.groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n"))
    w = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    found = counts.withColumns({"upto": F.sum("n").over(w), "total": total}).filter(F.col("upto") > F.ceil((F.col("total") - 1) * quantile))
    return found.agg(F.least(F.ceil(F.min("l") / multiple) * multiple, F.lit(cap)).cast("long").alias("max_length"))


def top_values(rows: DataFrame, value: str, k: int = 10) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def class_distribution(rows: DataFrame, column: str = "target") -> DataFrame:
    n = F.count("*")
    return rows.groupBy(column).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def changed_attributes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of cards (id, attributes as arrays of (k, v)): total and changed names, the latter with another or no value."""
    both = before.select("id", F.col("attributes").alias("old")).join(after.select("id", F.col("attributes").alias("new")), "id")
    return both.select("id", F.size("old").alias("total"), F.size(F.array_except("old", "new")).alias("changed"))


def throughput(batches: DataFrame) -> DataFrame:
    """One row from batches (examples, tokens, padded_tokens, seconds): rates and the share of tokens that isn't padding."""
    s = {c: F.sum(c) for c in ("examples", "tokens", "padded_tokens", "seconds")}
    return batches.agg((s["examples"] / s["seconds"]).alias("examples_per_second"), (s["tokens"] / s["seconds"]).alias("tokens_per_second"), (s["tokens"] / s["padded_tokens"]).alias("padding_efficiency"))

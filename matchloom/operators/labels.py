"""Label preparation: thresholds, overlap resolution, weights and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical, require_columns, seeded_key, uniform
from .numbering import with_row_number


def check(df: DataFrame, **wrong: Column) -> DataFrame:
    """df, or an error naming the rules that rows break: one aggregation over all rules."""
    found = df.agg(*[F.count_if(c).alias(name) for name, c in wrong.items()]).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ValueError(f"rows break rules: {broken}")
    return df


def validate_matches(matches: DataFrame, score: str = "target") -> DataFrame:
    """Columns are there, there are rows, ids and score are not null."""
    require_columns(matches, "id1", "id2", score)
    if matches.isEmpty():
        raise ValueError("no matches")
    return check(matches, null_id=F.col("id1").isNull() | F.col("id2").isNull(), null_score=F.col(score).isNull())


def rename_target(matches: DataFrame, column: str) -> DataFrame:
    return matches if column == "target" else matches.withColumn("target", F.col(column))


def with_defaults(matches: DataFrame) -> DataFrame:
    """sample_weight 1 and training_target = target where those columns are missing."""
    new = {"sample_weight": F.lit(1.0), "training_target": F.col("target").cast("double")}
    return matches.withColumns({k: v for k, v in new.items() if k not in matches.columns})


def _sound(value: Column, rule: Column, what: str) -> Column:
    """value, or an error where the rule does not hold or is null; found as the rows are read, not in a pass of its own."""
    return F.when(rule, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value.cast("string"), F.lit("null")))))


def hard_labels(matches: DataFrame) -> DataFrame:
    """Labels of 0 and 1 as they are, confidence 1. Drops nothing; another label (0.7, null, NaN) is an error when the
    rows are read."""
    target = _sound(F.col("target").cast("double"), F.col("target").cast("double").isin(0.0, 1.0), "a label is neither 0 nor 1").cast("int")
    return matches.withColumns({"target": target, "training_target": target.cast("double"), "confidence": F.lit(1.0)})


def probability_labels(matches: DataFrame, negative: float, positive: float, drop: bool = True, soft: bool = False) -> DataFrame:
    """Scores in [0, 1] as labels: confidence |2p - 1|, hard target p >= positive; drop keeps p <= negative or
    p >= positive; soft keeps p as training_target. A score that is null, not finite or outside [0, 1] is an error when
    the rows are read, whether it would be dropped or not."""
    p = F.col("target").cast("double")
    p = _sound(p, (p >= 0) & (p <= 1), "a score is not in [0, 1]")
    hard = (p >= positive).cast("int")
    rows = matches.filter((p <= negative) | (p >= positive)) if drop else matches
    return rows.withColumns({"target": hard, "training_target": p if soft else hard.cast("double"), "confidence": F.abs(2 * p - 1)})


def vote_labels(matches: DataFrame, total: int, negative: int, positive: int, drop: bool = True, soft: bool = False) -> DataFrame:
    """Scores that are shares of ``total`` votes: annotation_votes by rounding to even; drop keeps votes <= negative or
    >= positive, target votes >= positive; else target is 2 * votes >= total."""
    p = F.col("target").cast("double")
    votes = F.rint(p * total).cast("int")
    hard = ((votes >= positive) if drop else (votes * 2 >= total)).cast("int")
    rows = matches.filter((votes <= negative) | (votes >= positive)) if drop else matches
    return rows.withColumns({"annotation_votes": votes, "target": hard, "training_target": p if soft else hard.cast("double"), "confidence": F.abs(2 * p - 1)})


def steps_of_votes(matches: DataFrame, total: int) -> DataFrame:
    """matches, or an error where a score is not within 1e-5 of a whole number of votes."""
    p = F.col("target").cast("double") * total
    return check(matches, not_a_vote=F.abs(p - F.rint(p)) > 1e-5)


def resolve_overlaps(sources: dict[str, DataFrame], priority: list[str]) -> DataFrame:
    """All sources as one (data_source added), a pair only from its first source in ``priority``, whichever way round;
    had_overlap and had_conflict say whether other sources held it and with another target."""
    ranked = [canonical(sources[name]).withColumns({"data_source": F.lit(name), "rank": F.lit(k)}) for k, name in enumerate(priority)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    summary = rows.groupBy("u", "v").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.min("target").alias("t0"), F.max("target").alias("t1"))
    over = F.col("first_rank") < F.col("last_rank")
    kept = rows.join(summary, ["u", "v"]).filter("rank = first_rank")
    return kept.withColumns({"had_overlap": over, "had_conflict": over & (F.col("t0") != F.col("t1"))}).drop("rank", "first_rank", "last_rank", "t0", "t1")


def overlap_summary(sources: dict[str, DataFrame], priority: list[str]) -> DataFrame:
    """A row for each canonical pair: in how many sources, how many targets, the winning rank."""
    keys = None
    for k, name in enumerate(priority):
        part = canonical(sources[name]).select("u", "v", "target", F.lit(k).alias("rank"))
        keys = part if keys is None else keys.unionByName(part)
    return keys.groupBy("u", "v").agg(F.countDistinct("rank").alias("source_count"), F.countDistinct("target").alias("target_count"), F.min("rank").alias("winning_rank"))


def with_weights(matches: DataFrame, source_weight: float, floor: float | None = None, power: float = 1.0) -> DataFrame:
    """sample_weight = source weight * confidence multiplier * weight_multiplier (1 if missing); the confidence
    multiplier is max(floor, confidence ** power), 1 without a floor."""
    confidence = F.lit(1.0) if floor is None else F.greatest(F.lit(floor), F.pow("confidence", F.lit(power)))
    multiplier = F.col("weight_multiplier") if "weight_multiplier" in matches.columns else F.lit(1.0)
    rows = matches.withColumns({"confidence_multiplier": confidence, "weight_multiplier": multiplier})
    return rows.withColumn("sample_weight", source_weight * F.col("confidence_multiplier") * F.col("weight_multiplier"))


def group_counts(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count("*").alias("n"))


def proportional_quotas(counts: DataFrame, groups: list[str], max_rows: int) -> DataFrame:
    """Adds quota to group counts (n): floor of the proportional share, and one more for the largest remainders (ties in
    order of the groups) that still have rows. One row a group, so the windows over all groups are small."""
    every = Window.partitionBy().orderBy(*groups).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = F.col("n").cast("double") * (F.lit(float(max_rows)) / F.sum("n").over(every))
    parts = counts.withColumn("raw", raw).withColumn("base", F.floor("raw").cast("long"))
    parts = parts.withColumn("left", F.lit(max_rows) - F.sum("base").over(every)).withColumn("room", F.col("base") < F.col("n"))
    order = Window.partitionBy().orderBy(F.desc("room"), F.desc(F.col("raw") - F.col("base")), *groups)
    extra = F.col("room") & (F.row_number().over(order) <= F.col("left"))
    return parts.withColumn("quota", F.col("base") + extra.cast("long")).select(*groups, "n", "quota")


def hash_order_sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, the first by seeded hash of the key, then the key; a top-n, so no task sorts all rows."""
    return rows.withColumn("sample_key", seeded_key(seed, *key)).orderBy("sample_key", *key).limit(n)


#: Steps of a natural logarithm that scores are counted by: those of one step differ by a share of 1 / STEPS.
STEPS = 256


def _step(value: Column) -> Column:
    """A long that never falls while value grows, null first and NaN last: the logarithm's step, with value's sign."""
    v = value.cast("double")
    size = F.floor(F.least((F.ln(F.abs(v)) + 746) * STEPS, F.lit(1e9))).cast("long")
    return F.when(v.isNull(), F.lit(-(1 << 62))).when(F.isnan(v), F.lit(1 << 62)).when(v == 0, F.lit(0)).when(v < 0, -size).otherwise(size)


def _reached(counts: DataFrame, wanted: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """groups, name (the value, counted in _n, at which a group's rows reach ``_wanted``), _wanted (how many of that value's rows
    it takes). Groups with fewer rows have none."""
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).join(F.broadcast(wanted), groups).filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
    return found.select(*groups, F.col(value).alias(name), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_wanted"))


def first_by_quota(rows: DataFrame, quotas: DataFrame, groups: list[str], score: str, hashed: str, key: list[str]) -> DataFrame:
    """The first quota rows of each group by score, hashed (a long that spreads the keys), key, then the row itself.

    Rows are counted to find where a group reaches its quota: by steps of the score, then by score in that step, then, among
    rows of that score, by steps of the hash. A window then orders the rows that are left, about quota of them, so no task
    orders a whole group, and what meets in one are counts. The result is that of the order alone: each cut lets through all
    rows before it. ``rows`` are read once for each cut and again for the sample, so write them first if they are dear. Null
    scores come first, as in the order. Groups with a null go, as do those without a quota."""
    quotas = quotas.select(*groups, "quota").filter("quota > 0")
    n = F.count("*").alias("_n")
    counted = rows.groupBy(*groups, _step(F.col(score)).alias("_s")).agg(n)
    at = _reached(counted, quotas.withColumnRenamed("quota", "_wanted"), groups, "_s", "_at")
    inside = rows.join(F.broadcast(at), groups).filter(_step(F.col(score)) == F.col("_at"))
    cut = _reached(inside.groupBy(*groups, score).agg(n), at.select(*groups, "_wanted"), groups, score, "_cut")
    tied = rows.join(F.broadcast(cut), groups).filter(F.col(score).eqNullSafe(F.col("_cut")))
    last = _reached(tied.groupBy(*groups, _step(F.col(hashed)).alias("_h")).agg(n), cut.select(*groups, "_wanted"), groups, "_h", "_last")
    ends = at.drop("_wanted").join(cut.drop("_wanted"), groups).join(last.drop("_wanted"), groups)
    in_step = (F.col(score) < F.col("_cut")) | F.isnan(F.col("_cut").cast("double")) & ~F.isnan(F.col(score).cast("double")) | (F.col(score).eqNullSafe(F.col("_cut")) & (_step(F.col(hashed)) <= F.col("_last")))
    before = F.col("_at").isNull() | (_step(F.col(score)) < F.col("_at")) | ((_step(F.col(score)) == F.col("_at")) & in_step)
    left = rows.join(F.broadcast(quotas), groups).join(F.broadcast(ends), groups, "left").filter(before).drop("_at", "_cut", "_last")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(score, hashed, *key, "_row"))
    ranked = left.withColumn("_row", F.to_json(F.struct("*"))).withColumn("_rank", rank)
    return ranked.filter(F.col("_rank") <= F.col("quota")).drop("_row", "_rank", "quota")


def stratified_sample(rows: DataFrame, groups: list[str], key: list[str], max_rows: int, seed: int, strategy: str = "balanced", power: float = 2.0) -> DataFrame:
    """max_rows rows with proportional quotas for the groups.

    Within a group the order is by seeded hash ("balanced"), by -ln(U) / confidence ** power, a weighted draw without
    replacement ("confidence_weighted", confidence 0 last), or by confidence ("confidence_priority"); ties by hash, then
    key, then the row's other columns.
    """
    h = F.col("sample_hash")
    score = {
        "balanced": h.cast("double"),
        "confidence_weighted": F.when(F.col("confidence") == 0, float("inf")).otherwise(-F.ln(uniform(h)) / F.pow("confidence", F.lit(power))),
        "confidence_priority": -F.col("confidence"),
    }[strategy]
    hashed = rows.withColumn("sample_hash", seeded_key(seed, *key)).withColumn("sample_score", score)
    quotas = proportional_quotas(group_counts(rows, *groups), groups, max_rows)
    return first_by_quota(hashed, quotas, groups, "sample_score", "sample_hash", key).select(*rows.columns)


def head_per_group(rows: DataFrame, groups: list[str], n: int, seed: int, *key: str) -> DataFrame:
    """The first n rows of each group by seeded hash of the key, then the key; Spark keeps n a group in each task before
    the shuffle."""
    order = Window.partitionBy(*groups).orderBy("sample_key", *key)
    ranked = rows.withColumn("sample_key", seeded_key(seed, *key)).withColumn("sample_rank", F.row_number().over(order))
    return ranked.filter(F.col("sample_rank") <= n).drop("sample_key", "sample_rank")


def class_quota_sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows with classes 0 and 1 in their own proportion (class 0 rounded half to even), spilling over to the other
    class where one is short."""
    totals = rows.agg(F.count_if(F.col("target") == 0).alias("c0"), F.count_if(F.col("target") == 1).alias("c1")).first()
    total = totals["c0"] + totals["c1"]
    n = min(n, total)
    q0 = min(round(n * totals["c0"] / total), totals["c0"]) if total else 0
    q1 = min(n - q0, totals["c1"])
    q0 = n - q1
    quotas = rows.sparkSession.createDataFrame([(0, q0), (1, q1)], "target int, quota long")
    quotas = quotas.withColumn("target", F.col("target").cast(rows.schema["target"].dataType))
    keyed = rows.withColumn("sample_key", seeded_key(seed, *key))
    return first_by_quota(keyed, quotas, ["target"], "sample_key", "sample_key", list(key)).select(*rows.columns, "sample_key")


def spread_sample(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """k rows evenly spaced in a declared order: positions round(i * (n - 1) / (k - 1)), half to even, kept once."""
    n = rows.count()
    positions = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 and n else [0][:n]
    numbered = with_row_number(rows, "pair_row", *order)
    return numbered.filter(F.col("pair_row").isin(positions))


def length_buckets(rows: DataFrame, length: str, key: str, seed: int, megabatch: int, batch: int) -> DataFrame:
    """Adds megabatch and batch_key: rows dealt to megabatches by seeded hash, sorted by length inside, cut in batches
    that come in an order of their own. For batches of like length without a fixed order of lengths."""
    n = max(1, -(-rows.count() // megabatch))
    dealt = rows.withColumn("megabatch", F.pmod(seeded_key(seed, key), F.lit(n)))
    place = F.row_number().over(Window.partitionBy("megabatch").orderBy(length, key)) - 1
    return dealt.withColumn("batch", F.floor(place / batch)).withColumn("batch_key", seeded_key(seed + 1, "megabatch", "batch"))

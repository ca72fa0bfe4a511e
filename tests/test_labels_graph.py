import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import graph, labels, metrics, split

EDGES = "id1 long, id2 long, target int"


def weights(spark, rows, **options):
    found = graph.transitivity_weights(spark.createDataFrame(rows, EDGES if len(rows[0]) == 3 else EDGES + ", confidence double"), **options)
    return {(r.id1, r.id2): r for r in found.collect()}


def test_triangle_violations(spark):
    rows = [(1, 2, 1), (2, 3, 1), (1, 3, 0)]
    found = weights(spark, rows)
    assert all(r.transitivity_violations == 1 and r.weight_multiplier == pytest.approx(math.exp(-1)) for r in found.values())
    found = weights(spark, rows, min_comparable=2)
    assert all(r.transitivity_violations == 1 and r.weight_multiplier == 1 for r in found.values())


def test_weighted_violations_hit_the_least_certain_edge(spark):
    found = weights(spark, [(1, 2, 1, 5 / 9), (2, 3, 1, 1.0), (1, 3, 0, 1.0)], weighted=True)
    assert min(found, key=lambda k: found[k].weight_multiplier) == (1, 2)


def test_contradictions(spark):
    found = weights(spark, [(1, 2, 1), (2, 1, 0), (5, 5, 0), (6, 6, 1)])
    for pair in ((1, 2), (2, 1), (5, 5)):
        assert found[pair].transitivity_violations == 1 and found[pair].weight_multiplier == pytest.approx(math.exp(-1))
    assert found[(6, 6)].weight_multiplier == 1


def test_probability_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (0.95,)], "target double")
    assert [r.target for r in labels.probability_labels(df, 0.5, 0.5, drop=False).collect()] == [0, 0, 1, 1]


def test_vote_labels(spark):
    df = spark.createDataFrame([(k / 9,) for k in (0, 1, 2, 3, 6, 7, 8, 9)], "target double")
    assert labels.vote_labels(df, 9, 2, 7).count() == 6
    kept = spark.createDataFrame([(k / 9,) for k in (3, 4, 5, 6)], "target double")
    assert [r.target for r in labels.vote_labels(kept, 9, 2, 7, drop=False).collect()] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        labels.steps_of_votes(spark.createDataFrame([(0.5,)], "target double"), 9)


def test_confidence_weights(spark):
    df = labels.vote_labels(spark.createDataFrame([(0.0,), (2 / 9,), (7 / 9,), (1.0,)], "target double"), 9, 2, 7, soft=True)
    found = [r.sample_weight for r in labels.with_weights(df, 2.0, floor=0.2).collect()]
    assert found == pytest.approx([2, 10 / 9, 10 / 9, 2])


def test_overlaps_go_to_the_first_source(spark):
    human = spark.createDataFrame([(1, 2, 1), (3, 4, 0), (7, 8, 1)], EDGES)
    model = spark.createDataFrame([(2, 1, 1), (4, 3, 1), (5, 6, 1)], EDGES)
    found = labels.resolve_overlaps({"human": human, "model": model}, ["human", "model"]).collect()
    assert sorted((r.data_source, r.id1, r.id2) for r in found) == [("human", 1, 2), ("human", 3, 4), ("human", 7, 8), ("model", 5, 6)]
    assert {(r.id1, r.had_conflict) for r in found} == {(1, False), (3, True), (7, False), (5, False)}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_samples_do_not_depend_on_partitions(spark, parts):
    rows = [(i, i + 1, i % 2, "a" if i % 3 else "b", (i % 10) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, EDGES + ", category string, confidence double").repartition(parts)
    for strategy in ("balanced", "confidence_weighted", "confidence_priority"):
        found = labels.stratified_sample(df, ["category", "target"], ["id1", "id2"], 40, 7, strategy)
        assert found.count() == 40
        got = sorted(r.id1 for r in found.collect())
        test_samples_do_not_depend_on_partitions.seen.setdefault(strategy, got)
        assert test_samples_do_not_depend_on_partitions.seen[strategy] == got


test_samples_do_not_depend_on_partitions.seen = {}


def test_priority_sample_takes_the_surest(spark):
    rows = [(i, i + 100, int(v > 4), "c", abs(2 * v / 9 - 1), v) for i, v in enumerate((0, 0, 2, 2, 7, 7, 9, 9))]
    df = spark.createDataFrame(rows, EDGES + ", category string, confidence double, votes int")
    found = labels.stratified_sample(df, ["category", "target"], ["id1", "id2"], 4, 1, "confidence_priority").collect()
    assert sorted(r.votes for r in found) == [0, 0, 9, 9]


def test_quotas_of_tied_remainders_and_small_groups(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 97)], "g string, n long")
    found = {r.g: r.quota for r in labels.proportional_quotas(counts, ["g"], 50).collect()}
    assert sum(found.values()) == 50 and found["d"] in (48, 49) and all(found[k] <= 1 for k in "abc")


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(1, 2), (3, 4), (4, 5), (9, 9)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "id1 long, id2 long")).collect()}
    assert found == {x: find(x) for x in parent}


@pytest.mark.parametrize("scope", ["pair", "item"])
def test_split_does_not_leak(spark, scope):
    items = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(120)], "id long, category string")
    rows = [(i, i + 1, int(i % 4 == 0)) for i in range(0, 118, 2)] + [(i + 1, i, int(i % 4 == 0)) for i in range(0, 118, 4)]
    best = split.search_split(items, split.validate(items, spark.createDataFrame(rows, EDGES)), candidates=8, scope=scope)
    split.check_leakage(best.train, best.validation, scope)
    assert best.train.count() + best.validation.count() == len(rows)
    with pytest.raises(ValueError):
        split.check_leakage(best.train, best.train, scope)


def test_average_precision_of_ties(spark):
    rows = [("c", 1, 0.9), ("c", 0, 0.5), ("c", 1, 0.5), ("c", 0, 0.1), ("d", 1, 0.3)]
    df = spark.createDataFrame(rows, "category string, target int, predict double")
    found = {r.category: r.average_precision for r in metrics.average_precision(df, "category").collect()}
    assert found["c"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.macro_average_precision(df).first().groups == 1
    assert metrics.macro_average_precision(df, skip_single_class=False).first().groups == 2


def test_pair_set_hash_ignores_order_and_sides(spark):
    a = spark.createDataFrame([(1, 2), (10, 9), (3, 4)], "id1 long, id2 long")
    b = spark.createDataFrame([(4, 3), (9, 10), (2, 1)], "id1 long, id2 long").repartition(5)
    assert metrics.pair_set_hash(a).first() == metrics.pair_set_hash(b).first()


def test_runs_and_importance(spark):
    rows = [(1, i, v) for i, v in enumerate("aabba")]
    found = graph.runs(spark.createDataFrame(rows, "k long, i long, v string"), "k", ["i"], "v").orderBy("run").collect()
    assert [(r.v, r.first, r.last, r.length) for r in found] == [("a", 0, 1, 2), ("b", 2, 3, 2), ("a", 4, 4, 1)]
    scored = spark.createDataFrame([("x", "a", 0.5, 3, False)] * 40 + [("y", "a", 0.1, 3, True)] * 2, "category string, attribute string, score double, tokens int, truncated boolean")
    found = {(r.scope, r.category): r.origin for r in metrics.attribute_importance(scored, 30).collect()}
    assert found == {("global", None): "own", ("category", "x"): "own", ("category", "y"): "global"}


def test_empty_matches_are_an_error(spark):
    with pytest.raises(ValueError):
        labels.validate_matches(spark.createDataFrame([], EDGES))
    with pytest.raises(ValueError):
        labels.validate_matches(spark.createDataFrame([(1, 2, None)], EDGES))
    assert labels.with_defaults(spark.createDataFrame([(1, 2, 1)], EDGES)).filter((F.col("sample_weight") == 1) & (F.col("training_target") == 1)).count() == 1

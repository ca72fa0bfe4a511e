"""Word vectors with subwords and max pooling from tokens to predictions; samples whose strata are cut first."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import labels, models


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)


def test_unseen_words_are_close_to_their_stems(spark):
    known = {"running": [1.0, 0.0, 0.0], "jumping": [0.0, 1.0, 0.0], "camera": [0.0, 0.0, 1.0], "ring": [0.5, 0.5, 0.0]}
    words = spark.createDataFrame(list(known.items()), "word string, vector array<double>")
    asked = spark.createDataFrame([(w,) for w in ["runnings", "cameras", "jumping", "jumping", "ΩΩ", "", None, "x" * 5000]], "word string")
    grams = models.gram_vectors(words)
    found = {r.word: r.vector for r in models.token_vectors(asked, words, grams, 3).collect()}
    assert set(found) == {"runnings", "cameras", "jumping", "ΩΩ", "", "x" * 5000} and found["jumping"] == known["jumping"]
    for new, stem in (("runnings", "running"), ("cameras", "camera")):
        near = {w: cosine(found[new], v) for w, v in known.items()}
        assert max(near, key=near.get) == stem and near[stem] > 0.9
    assert found["ΩΩ"] == [0.0] * 3

    def brute(word):  # by the n-grams themselves: so few share no bucket
        grams = lambda w: {f"<{w}>"[i : i + n] for n in models.GRAMS for i in range(max(1, len(w) + 3 - n))}
        total, weights = [0.0] * 3, 0.0
        for g in grams(word):
            own = [v for w, v in known.items() if g in grams(w)]
            if own:
                total = [t + sum(v[k] for v in own) / len(own) ** 2 for k, t in enumerate(total)]
                weights += 1 / len(own)
        return [t / weights for t in total]

    assert found["runnings"] == pytest.approx(brute("runnings")) and found["cameras"] == pytest.approx(brute("cameras"))
    empty = words.limit(0)
    assert [r.vector for r in models.token_vectors(asked.limit(1), empty, models.gram_vectors(empty), 3).collect()] == [[0.0] * 3]


def test_max_pooling_end_to_end(spark):
    """Two topics; cards of the scored pairs have words that training never saw, with the topics' stems."""
    rng = random.Random(5)
    stems = {t: [f"{t}{c}{d}" for c in "abcd" for d in "xyz"] for t in ("lens", "boot")}
    cards = [(i, [rng.choice(stems["lens" if i % 2 else "boot"]) for _ in range(8)]) for i in range(300)]
    cards += [(i, [w + "s" for w in words]) for i, words in ((1000 + i, words) for i, words in cards[:60])]
    cards += [(5000, [])]
    items = spark.createDataFrame(cards, "item_id long, tokens array<string>")
    train = items.filter("item_id < 300")
    words = models.train_token_vectors(train, 8, partitions=2, passes=8)
    vectors = models.token_vectors(items.select(F.explode("tokens").alias("word")), words, models.gram_vectors(words), 8)
    pair = lambda low, n: [(a, b, float(a % 2 == b % 2), 1.0) for a, b in ((low + rng.randrange(n), low + rng.randrange(n)) for _ in range(400))]
    kind = "id1 long, id2 long, target double, sample_weight double"
    fitted, unseen = (models.max_pool_features(spark.createDataFrame(pair(low, n), kind), items, vectors, 8) for low, n in ((0, 300), (1000, 60)))
    model = models.train_mlp(fitted, [f"p{i}" for i in range(8)], hidden=8)
    scored = models.predict(unseen, model).collect()
    assert len(scored) == 400 and sum((r.predict > 0.5) == (r.target > 0.5) for r in scored) >= 380
    lone = models.max_pool_features(spark.createDataFrame([(5000, 1), (77777, 2)], "id1 long, id2 long"), items, vectors, 8).collect()
    assert len(lone) == 2 and all(r[f"p{i}"] == 0 for r in lone for i in range(8))


@pytest.mark.parametrize("strategy", ["balanced", "confidence_weighted", "confidence_priority"])
def test_cut_strata_give_the_ordered_sample(spark, strategy):
    """A stratum with most rows, tied confidences, equal keys and equal rows: as one ordering of everything would."""
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaaab"), rng.choice([0, 1]), f"k{rng.randrange(9000)}", rng.choice([0.0, 0.5, 0.5, 0.9, rng.random()])) for _ in range(12_000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "category string, target int, id1 string, confidence double")
    groups = ["category", "target"]
    quotas = {(r.category, r.target): r.quota for r in labels.proportional_quotas(labels.group_counts(df, *groups), groups, 700).collect()}
    h = {r.id1: r.h for r in df.select("id1", labels.seeded_key(9, "id1").alias("h")).distinct().collect()}
    score = {
        "balanced": lambda r: float(h[r[2]]),
        "confidence_weighted": lambda r: math.inf if r[3] == 0 else -math.log((h[r[2]] + 1) / 2**48) / r[3] ** 2,
        "confidence_priority": lambda r: -r[3],
    }[strategy]
    want = []
    for group, quota in quotas.items():
        want += sorted((r for r in rows if r[:2] == group), key=lambda r: (score(r), h[r[2]], r[2]))[:quota]
    for parts in (df, df.repartition(13)):
        found = labels.stratified_sample(parts, groups, ["id1"], 700, 9, strategy).collect()
        assert len(found) == 700
        assert sorted(r[:3] for r in map(tuple, found)) == sorted(r[:3] for r in want)
    assert labels.stratified_sample(df.limit(0), groups, ["id1"], 700, 9, strategy).count() == 0

"""Encoders that run out of memory, out-of-fold scores, and splits in three parts."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import encoders, models, split
from matchloom.plans import recipes


def test_batches_are_halved():
    asked = []

    def encoder(texts):
        asked.append(len(texts))
        if len(texts) > 5:
            raise MemoryError
        return [len(t) for t in texts]

    cleared = []
    run = encoders.Batches(encoder, 64, clear=lambda: cleared.append(1))
    texts = ["x" * i for i in range(103)]
    assert run(texts) == list(range(103)) and asked[:5] == [64, 32, 16, 8, 4] and max(asked[4:]) <= 4 and len(cleared) == 4
    asked.clear()
    assert run(texts) == list(range(103)) and max(asked) <= 4  # the size that went is kept
    with pytest.raises(MemoryError):
        encoders.Batches(lambda t: (_ for _ in ()).throw(MemoryError()), 8)(["a", "b"])
    with pytest.raises(ValueError, match="1 results for 2 texts"):
        encoders.Batches(lambda t: [0], 8)(["a", "b"])
    with pytest.raises(RuntimeError):  # no other error is taken for a lack of memory
        encoders.Batches(lambda t: (_ for _ in ()).throw(RuntimeError()), 8)(["a", "b"])


def limited():
    """A way to load an encoder that can't take more than three texts (local, so that workers get it by value)."""

    def load():
        def encode(texts):
            if len(texts) > 3:
                raise MemoryError
            return [[len(t), t.count("a")] for t in texts]

        return encode

    return load


@pytest.mark.parametrize("size", [1, 2, 50, 1000])
def test_same_rows_at_any_batch_size(spark, size):
    texts = [None if i % 7 == 0 else "a" * (i % 5) + "b" * i for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = {r.i: r.x for r in rows.select("i", encoders.encoded(F.col("t"), limited(), 2, size).alias("x")).collect()}
    assert found == {i: None if t is None else [len(t), t.count("a")] for i, t in enumerate(texts)}


def test_extracted_entities(spark):
    def load():
        return lambda texts: [[("word", w, t.index(w), t.index(w) + len(w), 0.5) for w in t.split()] for t in texts]

    rows = spark.createDataFrame([(1, "red lamp"), (2, ""), (3, None)], "i int, t string")
    found = {r.i: r.e for r in rows.select("i", encoders.extracted(F.col("t"), load).alias("e")).collect()}
    assert [(e.label, e.text, e.start, e.end, e.score) for e in found[1]] == [("word", "red", 0, 3, 0.5), ("word", "lamp", 4, 8, 0.5)]
    assert found[2] == [] and found[3] is None
    one = rows.filter("i = 1").select(encoders.entities_as_attributes(encoders.extracted(F.col("t"), load)).alias("a")).first().a
    assert [(x.k, x.v) for x in one] == [("word", "red")]


def test_a_vector_of_another_length(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="a vector of 2 instead of 3"):
        rows.select(encoders.encoded(F.col("t"), limited(), 3)).collect()


def test_no_row_is_scored_by_its_own_group(spark):
    rng = random.Random(1)
    data = [(i, f"g{rng.randint(0, 40)}", rng.choice("ab"), rng.randint(0, 1)) for i in range(500)]
    rows = spark.createDataFrame(data, "i int, grp string, kind string, target int")
    seen = []

    def fit(part):
        seen.append({r.grp for r in part.select("grp").distinct().collect()})
        return models.rate_scorer(part, "kind")

    found = models.out_of_fold(rows, fit, "grp", 4, 7).collect()
    assert sorted(r.i for r in found) == list(range(500))  # each once
    fold = {}
    for r in found:
        assert fold.setdefault(r.grp, r.fold) == r.fold and r.grp not in seen[r.fold]
    for r in found:
        others = [(k, t) for _, g, k, t in data if fold[g] != r.fold]
        mean = sum(t for _, t in others) / len(others)
        own = [t for k, t in others if k == r.kind]
        assert r.predict == pytest.approx((sum(own) + mean) / (len(own) + 1))
    with pytest.raises(ValueError, match="two folds"):
        models.with_fold(rows, "grp", 1)


@pytest.mark.parametrize("scope", ["pair", "item"])
def test_three_parts(spark, scope):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(400)], "id int, category string")
    pairs = {(a, min(399, a + rng.randint(1, 3))) for a in rng.choices(range(0, 396, 4), k=400)}
    matches = spark.createDataFrame([(a, b, rng.randint(0, 1)) for a, b in sorted(pairs) if a != b], "id1 int, id2 int, target int")
    parts = recipes.recipe("base")(items, matches, 0.2, 0.3, candidates=16, scope=scope)
    n = [p.count() for p in (parts.train, parts.validation, parts.stacking)]
    assert sum(n) == matches.count()
    check = {"pair": split.leaking_pairs, "item": split.leaking_items}[scope]
    for a, b in ((parts.train, parts.validation), (parts.train, parts.stacking), (parts.validation, parts.stacking)):
        assert check(a, b).isEmpty()
    assert abs(n[1] / sum(n) - 0.2) < 0.1 and abs(n[2] / sum(n) - 0.3) < 0.12
    told = {r.part: r for r in parts.quality.collect()}
    assert told["stacking"].fraction == pytest.approx(0.375) and 42 <= told["validation"].seed < 58 and 43 <= told["stacking"].seed < 59
    assert parts.validation.filter("sample_weight <> 1").isEmpty()
    two = recipes.base_splits(items, matches, candidates=8, scope=scope)
    assert two.stacking is None and two.train.count() + two.validation.count() == matches.count()
    with pytest.raises(ValueError, match="leave rows"):
        recipes.base_splits(items, matches, 0.5, 0.5)
    with pytest.raises(ValueError, match="base, mixed, predefined"):
        recipes.recipe("other")


def test_predefined_split(spark):
    items = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(12)], "id int, category string")
    train = spark.createDataFrame([(0, 1, 1), (2, 3, 0), (4, 5, 1), (1, 3, 0)], "id1 int, id2 int, target int")
    validation = spark.createDataFrame([(6, 7, 1), (8, 9, 0)], "id1 int, id2 int, target int")
    parts = recipes.recipe("predefined")(items, train, validation)
    q = parts.quality.first()
    assert (q.fraction, q.missing_strata, q.size_error) == (pytest.approx(1 / 3), 0, 0.0) and parts.validation.first().sample_weight == 1.0
    with pytest.raises(ValueError, match="pair leakage"):
        recipes.predefined_splits(items, train, validation.union(train.limit(1).select("id2", "id1", "target")))


def test_unknown_items_raise(spark):
    from matchloom.operators import pairs

    items = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    good, bad = (spark.createDataFrame(rows, "id1 int, id2 int") for rows in ([(1, 2), (2, 1)], [(1, 2), (1, 9)]))
    assert {(r.name_1, r.name_2) for r in pairs.assemble(items, good, ("name",), known=True).collect()} == {("a", None), (None, "a")}
    assert pairs.assemble(items, bad, ("name",)).filter("id2 = 9").first().name_2 is None
    with pytest.raises(Exception, match="unknown item: 9"):
        pairs.assemble(items, bad, ("name",), known=True).collect()


def test_comparisons_fold_ligatures_and_sharp_s(spark):
    from matchloom.operators import pairs

    kind = "pair_row int, attributes_1 array<struct<k:string,v:string>>, attributes_2 array<struct<k:string,v:string>>"
    rows = [(1, [("Straße", "ﬁne № ①")], [("STRASSE", "Fine no 1")]), (2, [("Цвет", "ЁЛКА")], [("цвет", "елка")]), (3, [("a", "x")], [("a", "y")]), (4, None, [("ﬀ", "1")])]
    found = {r.pair_row: (r.name, r.both_present, r.exact) for r in pairs.compare_attributes(spark.createDataFrame(rows, kind)).collect()}
    assert found[1] == ("strasse", True, 1.0) and found[2] == ("цвет", True, 1.0) and found[3] == ("a", True, 0.0) and found[4] == ("ff", False, 0.0)


def test_search_gives_the_same_best_setting(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, rng.choice("abcdefgh"), int(rng.random() < 0.3)) for i in range(400)], "i int, kind string, target int")
    train, validation = rows.filter("i % 4 > 0"), rows.filter("i % 4 = 0")
    space = {"prior": ("log", 0.01, 1000.0), "by": ("choice", "kind", "i")}
    fit = lambda part, by, prior: models.rate_scorer(part, by, prior)
    loss = lambda p: F.avg(F.pow(p - F.col("target"), F.lit(2)))
    found = models.search_parameters(train, validation, fit, space, loss, 6, 3)
    again = models.search_parameters(train.repartition(3), validation, fit, dict(reversed(space.items())), loss, 6, 3, at_once=2)
    assert [s for _, s in found] == [s for _, s in again] and [v for v, _ in found] == sorted(v for v, _ in found) and len(found) == 6
    best = found[0][1]
    want = models.rate_scorer(train, **best)(validation).select(F.avg(F.pow(F.col("predict") - F.col("target"), F.lit(2)))).first()[0]
    assert found[0][0] == pytest.approx(want)
    drawn = models.sample_space({"n": ("int", 1, 3), "x": ("uniform", 0.5, 0.6)}, 50, 1)
    assert {d["n"] for d in drawn} == {1, 2, 3} and all(0.5 <= d["x"] <= 0.6 for d in drawn) and drawn == models.sample_space({"x": ("uniform", 0.5, 0.6), "n": ("int", 1, 3)}, 50, 1)
    with pytest.raises(ValueError, match="unknown kinds"):
        models.sample_space({"n": ("normal", 0, 1)}, 1)

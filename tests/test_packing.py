"""Packed pairs and token owners against a plain loop over tokens."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import packing
from matchloom.functions.text import attributes


def brute_fit(required, sections, budget, skip):
    """(tokens, kept) by putting sections one after another."""
    if len(required) >= budget:
        return required[:budget], []
    out, kept = list(required), []
    for i, (_, tokens) in enumerate(sections):
        if len(out) + len(tokens) <= budget:
            out, kept = out + tokens, kept + [i]
        elif not skip:
            break
    return out, kept


def brute_pack(a, b, budget, skip):
    """Shares are made even, then whatever is left is offered again and again until nobody gains."""
    want = [len(x[0]) + sum(len(t) for _, t in x[1]) for x in (a, b)]
    share = [0, 0]
    for turn in range(budget):  # a token at a time: to who has less (the left one first) and still wants some
        open_ = [i for i in (0, 1) if share[i] < want[i]]
        if open_:
            share[min(open_, key=lambda i: (share[i], i))] += 1
    fits = [brute_fit(*x, s, skip) for x, s in zip((a, b), share)]
    while True:
        left = budget - sum(len(f[0]) for f in fits)
        more = [brute_fit(*x, len(f[0]) + left, skip) for x, f in zip((a, b), fits)]
        gains = [len(m[0]) - len(f[0]) for m, f in zip(more, fits)]
        if left <= 0 or max(gains) <= 0:
            return fits
        side = 0 if gains[0] >= gains[1] else 1
        fits[side] = more[side]


def made(rng):
    card = lambda side: ([f"{side}r{i}" for i in range(rng.randint(0, 6))], [(rng.choice("abc"), [f"{side}{k}.{i}" for i in range(rng.randint(0, 7))]) for k in range(rng.randint(0, 6))])
    return card("l"), card("r")


CARD = "struct<required:array<string>,sections:array<struct<k:string,tokens:array<string>>>>"


@pytest.mark.parametrize("skip", [False, True])
def test_pairs_are_packed(spark, skip):
    rng = random.Random(3)
    cards = [made(rng) for _ in range(150)]
    for budget in (1, 2, 7, 16, 60):
        rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cards)], f"i int, left {CARD}, right {CARD}")
        found = packing.encode_pairs(rows, budget + 3, skip_oversized=skip).withColumn("by_token", packing.owner_of_tokens(F.col("tokens"), F.col("owners"))).collect()
        assert len(found) == len(cards)
        for r in found:
            a, b = cards[r.i]
            (left, kl), (right, kr) = brute_pack(a, b, budget, skip)
            assert r.tokens == ["[CLS]", *left, "[SEP]", *right, "[SEP]"]
            assert r.token_types == [0] * (len(left) + 2) + [1] * (len(right) + 1)
            owner = {t: k for card in (a, b) for k, tokens in card[1] for t in tokens}
            assert r.by_token == [owner.get(t) for t in r.tokens]
            assert r.present == dict(Counter(k for card in (a, b) for k, _ in card[1]))
            assert r.included == dict(Counter([a[1][i][0] for i in kl] + [b[1][i][0] for i in kr]))
            # no token more than the budget, and nothing could be added on either side
            spare = budget - len(left) - len(right)
            assert spare >= 0
            for (required, sections), kept, used in ((a, kl, left), (b, kr, right)):
                later = [len(t) for i, (_, t) in enumerate(sections) if i not in kept and (skip or i == len(kept))]
                assert len(used) < len(required) and not spare or len(used) == len(required) and not kept or all(n > spare for n in later)


def test_sections_of_a_card(spark):
    rows = spark.createDataFrame([("Red Lamp", "home lamps", '{"color":"deep red","w":"5","note":"a b c d e"}'), (None, None, None)], "name string, category string, attrs string")
    a = attributes(F.col("attrs"))
    for style, first, prefix in (("plain", ["name:", "Red", "Lamp", "category:", "home", "lamps"], ["w:"]), ("markers", ["[KEY]", "name", "[VAL]", "Red", "Lamp", "[KEY]", "category", "[VAL]", "home", "lamps"], ["[KEY]", "w", "[VAL]"])):
        texts = packing.card_texts(F.col("name"), F.col("category"), a, style, value_chars=7)
        card = packing.card_sections(packing.word_tokens(texts), a, value_tokens=3)
        full, empty = rows.select(card.alias("c")).collect()
        assert full.c.required == first and [s.k for s in full.c.sections] == ["w", "color", "note"]
        assert full.c.sections[0].tokens == [*prefix, "5"] and full.c.sections[2].tokens[-3:] == ["a", "b", "c"]
        assert empty.c.sections == [] and "Red" not in empty.c.required


def test_a_tokenizer_of_its_own(spark):
    """Ids from an Arrow function over arrays of texts; special tokens as ids too."""
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda own: [[ord(c) for c in t.replace(" ", "")] for t in own])

    rows = spark.createDataFrame([("ab", "c", [("k", "vw"), ("much", "longer value")])], "name string, category string, a array<struct<k:string,v:string>>")
    tokens = rows.withColumn("t", letters(packing.card_texts(F.col("name"), F.col("category"), F.col("a"))))
    card = packing.card_sections(F.col("t"), F.col("a"))
    got = packing.encode_pairs(tokens.select(card.alias("left"), card.alias("right")), 40, layout="roberta", special={"<s>": -1, "</s>": -2}).first()
    must = [ord(c) for c in "name:abcategory:c"]
    assert got.tokens == [-1, *must, -2, -2, *must, -2] and got.owners == []
    more = packing.encode_pairs(tokens.select(card.alias("left"), card.alias("right")), 46, layout="roberta", special={"<s>": -1, "</s>": -2}).first()
    assert [(o.k, o.first, o.last) for o in more.owners] == [("k", 18, 21), ("k", 41, 44)]


def test_coverage_and_errors(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame(made(rng) and [made(rng) for _ in range(40)], f"left {CARD}, right {CARD}")
    encoded = packing.encode_pairs(rows, 20)
    got = {r.key: (r.present, r.included, r.tokens) for r in packing.attribute_coverage(rows, 17).collect()}
    want = {}
    for r in encoded.collect():
        for k, n in r.present.items():
            x = want.setdefault(k, [0, 0, 0])
            x[0] += n
            x[1] += r.included.get(k, 0)
        for o in r.owners:
            want[o.k][2] += o.last - o.first + 1
    assert got == {k: tuple(v) for k, v in want.items()}
    with pytest.raises(ValueError, match="budget"):
        packing.encode_pairs(rows, 3)
    with pytest.raises(ValueError, match="in the way"):
        packing.pack_pairs(rows.withColumn("_l1", F.lit(1)), 5)
    assert packing.encode_pairs(rows.limit(0), 20).count() == 0


@pytest.mark.parametrize("n, sample, quantile", [(50, 10_000, 0.95), (1000, 37, 0.9), (1000, 999, 0.5), (11, 1, 1.0), (7, 7, 0.3)])
def test_length_of_an_even_sample(spark, n, sample, quantile):
    rng = random.Random(n)
    lengths = [rng.randint(1, 700) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "i int, n int").repartition(5)
    chosen = [lengths[int(i)] for i in np.linspace(0, n - 1, sample, dtype=int)] if n > sample else lengths
    want = min(512, max(8, -(-int(np.quantile(chosen, quantile, method="higher")) // 8) * 8))
    assert packing.inferred_length(rows, "n", "i", quantile, sample).first().max_length == want


def test_fits_that_are_looked_up(spark):
    rng = random.Random(4)
    cards = [made(rng) for _ in range(150)]
    for budget in (1, 2, 7, 16, 60):
        rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cards)] + [(-1, None, cards[0][1])], f"i int, left {CARD}, right {CARD}")
        fitted = rows.select("i", *[packing.fitted_card(F.col(c), budget).alias(c) for c in ("left", "right")])
        fits = packing.fit_pairs(fitted, budget, "left", "right")
        assert fits.columns == ["i", "left", "right", "left_share", "right_share"]
        out = [f(c, *more, f"{c}_share").alias(f"{c}_{name}") for c in ("left", "right") for name, f, more in (("tokens", packing.start_of, ("tokens",)), ("owners", packing.start_of, ("owners",)), ("used", packing.used_of, ()), ("kept", packing.kept_of, ()))]
        for r in fits.select("*", *out).collect():
            if r.i < 0:
                assert r.left_share is None and r.right_share is None
                continue
            a, b = cards[r.i]
            (left, kl), (right, kr) = brute_pack(a, b, budget, False)
            owner = {t: k for card in (a, b) for k, tokens in card[1] for t in tokens}
            assert (r.left_tokens, r.right_tokens, r.left_used, r.right_used, r.left_kept, r.right_kept) == (left, right, len(left), len(right), len(kl), len(kr))
            assert r.left_owners == [owner.get(t) for t in left] and r.right_owners == [owner.get(t) for t in right]
    with pytest.raises(ValueError, match="budget"):
        packing.fit_pairs(fitted, 0, "left", "right")


def test_coverage_packs_alike_pairs_once(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([made(rng) for _ in range(40)] * 3 + [(None, made(rng)[1])], f"left {CARD}, right {CARD}")
    shapes = rows.select(*[packing.shape(F.col(c)).alias(c) for c in ("left", "right")])
    for skip in (False, True):
        found = packing.attribute_coverage(shapes, 17, skip_oversized=skip)
        assert sorted(found.collect()) == sorted(packing.attribute_coverage(rows, 17, skip_oversized=skip).collect())
        # pairs are counted by their cards before any is packed
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Aggregate [") == 2, text

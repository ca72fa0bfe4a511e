"""Collocations against brute force, and the perfect hash they stand on."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import collocations


def brute(rows, frequent, top=collocations.TOP):
    """lang, rank, phrase, a, l, r, n, score from (text, lang) by counting all phrases."""
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter()) if lang != "" else f.setdefault("", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found, cands = [], {p: a for p, a in own.items() if len(p) > 1 and a >= frequent}
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(docs):
    return sorted(tuple(r) for r in collocations.collocations(docs).collect())


@pytest.mark.parametrize("block, held, piece", [(1 << 19, 1 << 19, 1 << 16), (7, 5, 4)])
def test_collocations(spark, awkward, nothing, monkeypatch, block, held, piece):
    """Also with many blocks, rounds and pieces, and words passed on early."""
    for name, value in {"FREQUENT": 3, "BLOCK": block, "HELD": held, "HELD_KEYS": held, "PIECE": piece, "ROUND": 3 * piece, "ROW": 50, "CHUNK": 60 if block < 100 else 1 << 19}.items():
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(4)
    vocabulary = ["new", "york", "city", "New", "hot", "dog", "ü", "a\0b", "日本", "s\x1cx", "#", "é\t"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + [". ", ",", "\n", "  ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["new york city hall " * 50, "x x x x x x x", "rare " * 2]
    made = spark.createDataFrame([(i, t, ("en", None, "und", "")[i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = awkward.unionByName(made, allowMissingColumns=True)
    want = brute([(r.text, r.lang) for r in docs.collect()], 3)
    assert len(want) > 50 and found(docs) == want and found(docs.repartition(5)) == want
    assert found(nothing) == [] and found(made.filter("doc_id = 82")) == []


def test_first_phrases_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FREQUENT", 2)
    monkeypatch.setattr(collocations, "TOP", 5)
    text = ". ".join(f"w{i} v{i}" for i in range(40)) + ". "  # ties but for the phrase
    assert found(spark.createDataFrame([(text, "en"), (text, "en")], "text string, lang string")) == brute([(text, "en")] * 2, 2, 5)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, both = 8_000_000_000_000_000_000, 9_000_000_000_000_000_001
    df = spark.createDataFrame([(a, both)], "a long, b long")
    assert df.select(collocations._score("a", "b").alias("s")).first().s == 2_000_000 * a // both
    assert df.select(F.col("a")).count() == 1


def test_perfect_hash(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000))
    own, other = keys[::2], keys[1::2]
    made = collocations.PerfectHash.build(own, own ^ 5)
    made.save(str(tmp_path / "h"))
    for h in (made, collocations.PerfectHash.load(str(tmp_path / "h"))):
        assert sorted(h.slots(own, own ^ 5).tolist()) == list(range(len(own)))  # minimal and perfect
        assert (h.slots(other, other ^ 5) == -1).all() and (h.slots(own, own) == -1).all()
    assert len(collocations.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3
    with pytest.raises(ValueError, match="distinct"):
        collocations.PerfectHash.build(np.array([1, 1]))

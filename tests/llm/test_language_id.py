"""Language identification: held-out accuracy, and what may be learned from."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import common, language_id


def test_held_out_accuracy(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out and r.lang]
    assert len(held) > 150
    right = np.mean([r.lang_pred == r.lang for r in held])
    print("held out", len(held), right)
    assert right > 0.97


def test_what_is_learned(spark):
    """Neither held-out labels nor lang, source and doc_id of the document asked about."""
    docs = common.documents(spark, "/root/testdata/sf0.001")
    kept = ~language_id.held_out(F.col("doc_id"))
    other = docs.withColumns({"lang": F.when(kept, F.col("lang")).otherwise("xx"), "source": F.lit("elsewhere")})
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify(df).collect())
    want = key(docs)
    assert key(other) == want and key(docs.repartition(5)) == want  # reruns agree


def test_languages_close_and_far(spark):
    """Three languages in a family, one that is a family of its own, and one with a region."""
    rng = random.Random(2)
    syllables = {"nl": ["een", "ij", "oo", "van", "het"], "de": ["ein", "ung", "sch", "von", "das"], "en-GB": ["the", "ing", "tion", "of", "sh"], "pl": ["szcz", "ow", "nie", "prz", "ą"], "qq": ["ъы", "щю", "ё", "эй"]}
    text = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(40))
    rows = [(i * 5 + k, text(s), lang) for i in range(40) for k, (lang, s) in enumerate(syllables.items())]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in found)
    assert language_id.family("pt_BR") == "romance" and language_id.family("qq") == "qq"


def test_awkward(spark, awkward, nothing):
    found = language_id.identify(awkward).collect()
    assert len(found) == awkward.count()
    by = {r.doc_id: r.text for r in awkward.collect()}
    for r in found:
        text = by[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
        assert r.lang_pred in ("en", "de", "und")
    assert language_id.identify(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0)}
    one = awkward.withColumn("lang", F.lit("fi"))
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"fi", "und"}


def test_sample_is_bounded(spark, monkeypatch):
    """A hot text counts once, and a language has its rows whatever the others have."""
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 30)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}", "en" if i % 50 else "fr") for i in range(3000)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    count = {k: sum(r.lang == k for r in got) for k in ("en", "fr")}
    assert count["en"] == 30 and 20 <= count["fr"] <= 30 and len({(r.lang, r.text) for r in got}) == len(got)
    ids = {t: i for i, t, _ in rows}
    assert all(r.text == "hot text" or zlib.crc32(str(ids[r.text]).encode()) % 4 != 2 for r in got)


def test_machine_finds_a_margin():
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1 + k % 7], np.int32), np.array([v, 0.3], np.float32)) for k, v in enumerate(rng.choice([-1.0, 1.0], 200))]
    labels = np.array([1 if x[0] > 0 else -1 for _, x in rows])
    w, b = language_id.support_vector_machine(rows, labels)
    assert all(y * (w[at] @ x + b) > 0.5 for (at, x), y in zip(rows, labels))
    with pytest.raises(IndexError):
        language_id.support_vector_machine([(np.array([language_id.BUCKETS]), np.array([1.0]))], np.array([1]))

"""The pipeline's stages one after another, each judged on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.llm import quality_rules, simhash
from matchloom.llm.common import documents, materialize

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, D), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs, (after := materialize(stage(spark, docs, D), f"test-{name}"))
        docs = after
    return out


def test_columns(spark, stages):
    assert list(stages) == ["quality_rules", "near_dedup", "secrets", "mixing", "encoding"]
    assert all(after.columns == documents(spark, D).columns for name, (_, after) in stages.items() if name != "encoding")


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    kept = quality_rules.judge(before).filter("v.kept").select("row.*")
    assert after.exceptAll(kept).isEmpty() and kept.exceptAll(after).isEmpty()


def test_dedup_stage(stages):
    before, after = stages["near_dedup"]
    want = {r.component_id for r in simhash.near_duplicate_components(before).collect()}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)


def test_secrets_stage(stages):
    before, after = stages["secrets"]
    assert before.count() == after.count() and after.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).isEmpty()
    assert after.filter(F.col("n_chars") != F.char_length("text")).isEmpty()


def test_mixing_and_encoding_stage(stages):
    before, after = stages["mixing"]
    assert after.select("doc_id").subtract(before.select("doc_id")).isEmpty() and after.groupBy("doc_id").count().filter("count > 3").isEmpty()
    mixed, encoded = stages["encoding"]
    assert encoded.count() == mixed.count()
    both = encoded.join(mixed.select("doc_id", F.sha2("text", 256).alias("own")).distinct(), "doc_id")
    assert both.filter("own <> decoded_sha256").isEmpty()


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []


def test_stages_over_awkward_and_empty_tables(spark, awkward, nothing):
    """Nulls, repeats and clashing names in, the same columns out."""
    for start in (awkward, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, docs, D), "test-awkward")
            assert name == "encoding" or after.columns == start.columns
            assert start is awkward or after.isEmpty()
            docs = docs if name == "quality_rules" else after  # the quality rules leave too little of it

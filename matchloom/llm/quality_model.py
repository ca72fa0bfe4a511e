"""Quality classifier from weak labels (operator 1).

Overlapping heuristic labellers vote good, bad or nothing on every document; expectation-maximisation over the counts of
all vote patterns estimates their accuracies; the posteriors are soft labels for a hashed linear scorer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .quality_rules import JUNK, _base

#: The scorer's hash buckets, of which the last SHAPES are for the binned shape of a text.
BUCKETS, SHAPES, BINS = 1 << 15, 64, 8
#: Documents that the scorer is trained on, at most (all are counted, labelled and scored).
TRAIN_ROWS = 8_000
LABELLERS = ("length", "marks", "lines", "repeats", "word_length", "ending", "fluent")


def shape(text: str) -> tuple[float, ...]:
    """Words, marks a word, share of repeated lines, of words in repeated windows and of words like the one before,
    characters a word, and the last character's kind (1 ends a sentence, 0 is a junk mark, 0.5 another)."""
    n, chars, marks, dups, repeated = _base(text)
    words = text.split()
    lines = sum(1 for x in text.split("\n") if x.strip()) or 1
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    last = text.rstrip()[-1:] or "#"
    m = max(n, 1)
    return n, marks / m, dups / lines, repeated / m, stutter / m, chars / m, 1.0 if last in '.!?"»”…。' else 0.0 if last in JUNK else 0.5, lines


def votes(s: tuple[float, ...]) -> list[int]:
    """1 good, 0 bad, -1 no vote, in the order of LABELLERS."""
    n, marks, dups, repeated, stutter, chars, last, lines = s
    marked, repeats = marks > 0.1, repeated > 0.3 or stutter > 0.2
    fluent = n >= 5 and marks < 0.05 and repeated < 0.3 and stutter < 0.05 and 2.5 <= chars <= 9

    def vote(bad: bool, good: bool) -> int:
        return 0 if bad else 1 if good else -1

    return [vote(n < 5, n >= 50), vote(marked, False), vote(dups > 0.5, False), vote(repeats, False), vote(chars < 2 or chars > 12, 3 <= chars <= 8), vote(last == 0, last == 1), vote(False, fluent)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of good for each vote pattern, from how many documents show it; and the labellers' accuracies (of the
    votes given, the share that is right).

    Each labeller has, for either class, a chance to vote good, bad or not at all; votes are independent given the
    class. The first guess is that votes are more often right than wrong; a made-up vote of each kind keeps chances
    off 0.
    """
    shows = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
    prior, chance = 0.7, np.tile(np.array([[0.4, 0.5, 0.1], [0.4, 0.1, 0.5]])[:, None, :], (1, patterns.shape[1], 1))
    for _ in range(rounds):
        fit = [np.einsum("pjv,jv->p", shows, np.log(chance[y])) for y in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(math.log(1 - prior) + fit[0] - math.log(prior) - fit[1], -500, 500)))
        weight = [counts * (1 - post), counts * post]
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        chance = np.stack([(np.einsum("p,pjv->jv", w, shows) + 1) / (w.sum() + 3) for w in weight])
    right = prior * chance[1][:, 2] + (1 - prior) * chance[0][:, 1]
    given = right + prior * chance[1][:, 1] + (1 - prior) * chance[0][:, 2]
    return post, {"prior": float(prior), "accuracy": dict(zip(LABELLERS, (right / given).round(4).tolist()))}


def _shape_slots(s: tuple[float, ...]) -> list[int]:
    """A bucket for each part of the shape."""
    n, *shares, chars, last, _ = s
    bins = [min(BINS - 1, int(math.log2(n + 1) / 1.5)), *[min(BINS - 1, math.ceil(x * 10)) for x in shares], min(BINS - 1, int(chars)), int(last * 2)]
    return [BUCKETS - SHAPES + k * BINS + b for k, b in enumerate(bins)]


def _trigrams(text: str) -> np.ndarray:
    """Hash bucket of each byte trigram."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(8)).astype(np.int64) % (BUCKETS - SHAPES)


def _texts(texts: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in texts]


@F.pandas_udf(T.StringType())
def pattern(texts: pd.Series) -> pd.Series:
    return pd.Series(["".join("-01"[v + 1] for v in votes(shape(t))) for t in _texts(texts)], dtype=object)


@F.udf(VectorUDT())
def hashed(text):
    """Trigram shares and shape slots of a text; for the bounded training sample only."""
    text = text or ""
    grams = np.bincount(_trigrams(text), minlength=BUCKETS).astype(float)
    grams /= max(grams.sum(), 1)
    grams[_shape_slots(shape(text))] = 1.0
    at = np.flatnonzero(grams)
    return SparseVector(BUCKETS, at.tolist(), grams[at].tolist())


class Scorer:
    """P(good) of a text: logistic of bias + mean trigram weight + shape weights."""

    def __init__(self, weights: np.ndarray, bias: float, posterior: dict[str, float], accuracy: dict[str, float]):
        self.weights, self.bias, self.posterior = weights, bias, posterior
        self.agreement = {p: self._agreement(p, y >= 0.5, list(accuracy.values())) for p, y in posterior.items()}

    @staticmethod
    def _agreement(votes: str, good: bool, accuracy: list[float]) -> float | None:
        signed = [a if (v == "1") == good else -a for v, a in zip(votes, accuracy) if v != "-"]
        return round(sum(signed) / len(signed), 6) if signed else None

    def score(self, texts: list[str]) -> pd.DataFrame:
        out = []
        for t in texts:
            s, grams = shape(t), _trigrams(t)
            z = self.bias + self.weights[_shape_slots(s)].sum() + (self.weights[grams].mean() if len(grams) else 0.0)
            own = "".join("-01"[v + 1] for v in votes(s))
            out.append((own, self.agreement[own], self.posterior[own], 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))))
        return pd.DataFrame(out, columns=["pattern", "agreement", "weak_label", "score"])


def fit(docs: DataFrame) -> tuple[Scorer, dict] | None:
    """Counts the vote patterns of all documents (at most 3 ** 7), runs EM over them, and trains the scorer on about
    TRAIN_ROWS documents, at most, picked by a hash of doc_id and text, each as both classes with its posterior as
    weights. None for an empty table."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    table = texts.groupBy(pattern("text").alias("pattern")).count().toPandas().sort_values("pattern", ignore_index=True)
    if table.empty:
        return None
    seen = np.array([["-01".index(v) - 1 for v in p] for p in table["pattern"]])
    post, about = expectation_maximisation(seen, table["count"].to_numpy(float))
    posterior = dict(zip(table["pattern"], post.tolist()))
    # a bit more than wanted by hash, then the first of those by hash: no more, whatever is repeated how often
    share = min(1.0, 1.25 * TRAIN_ROWS / table["count"].sum())
    mixed = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit("")))
    drawn = docs.select(mixed.alias("h"), F.coalesce(docs["text"], F.lit("")).alias("text")).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = drawn.orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(TRAIN_ROWS)
    rows = materialize(picked.select(pattern("text").alias("pattern"), hashed("text").alias("features")), "weak-labels")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in posterior.items() for x in kv]), F.col("pattern"))
    soft = rows.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), weight.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - weight).alias("w")))).alias("s")).select("features", "s.*")
    if rows.isEmpty():
        return Scorer(np.zeros(BUCKETS), 0.0, posterior, about["accuracy"]), about
    model = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=30, standardization=True).fit(soft)
    return Scorer(model.coefficients.toArray().astype(np.float32), float(model.intercept), posterior, about["accuracy"]), about


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, pattern (the labellers' votes, "1" good, "0" bad, "-" none), agreement (the mean
    estimated accuracy of those that vote as the posterior says, less that of those that don't; null without votes),
    weak_label (posterior), score, kept (score >= threshold).

    Null texts count as empty (bad by every labeller that votes); null doc_ids and repeated rows stay; very long texts
    are read whole; an empty table gives no rows. Other columns are not read.
    """
    fitted = fit(docs)
    scorer = docs.sparkSession.sparkContext.broadcast(fitted[0] if fitted else None)  # BUCKETS weights, 3 ** 7 posteriors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = scorer.value.score(_texts(pdf["text"]))
            yield found.assign(doc_id=pdf["doc_id"].astype("Int64").array, kept=found["score"] >= threshold)

    kind = "doc_id long, pattern string, agreement double, weak_label double, score double, kept boolean"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(run, kind)

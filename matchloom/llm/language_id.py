"""Language identification in two steps (operator 13).

A linear classifier first tells the language's family; within it, one linear support vector machine for each pair of
languages votes. Features are hashed byte n-grams of a text's words. Each machine is trained in a task of its own, on a
bounded sample of each language's labelled texts; every text is predicted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions

UNKNOWN = "und"
#: Hash buckets of n-grams of 2, 3 and 4 bytes.
BUCKETS, ORDERS = 1 << 14, (2, 3, 4)
#: Labelled texts a language that are trained on, at most; of them in the choice of a family, all languages together.
TRAIN_ROWS, FAMILY_ROWS = 1_000, 6_000
#: Passes over the sample, and how much mistakes weigh.
EPOCHS, COST = 12, 20.0
#: Families of languages by ISO 639-1 code. A language that isn't here is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps sd si tg ur",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "austronesian": "id jv mg mi ms su tl",
    "sinitic": "yue zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SPACE_ONLY = bytes(range(9, 14))
#: A-Z as a-z, white space as blanks, digits and marks that say nothing of a language as one mark.
FOLDED = bytes.maketrans(bytes(range(65, 91)) + SPACE_ONLY + b"0123456789#*$%&|<>=+_~^\\@/", bytes(range(97, 123)) + b" " * 5 + b"0" * 26)


def family(lang: str) -> str:
    """Of a code, with or without a region."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from. A null id's text is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order and their weights: square roots of the n-grams' shares, of length 1."""
    raw = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLDED).split()) + b" ", np.uint8).astype(np.uint32)
    counts, code = np.zeros(BUCKETS), raw
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] << np.uint32(8) | raw[n - 1 :]
        if n in ORDERS and len(code):
            h = (code + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weight = np.sqrt(counts[at])
    return at.astype(np.int32), (weight / max(np.sqrt((weight**2).sum()), 1e-12)).astype(np.float32)


def support_vector_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for labels of -1 and 1, by dual coordinate descent over squared hinge losses;
    the rarer class weighs as much as the other."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    often = {y: max(1, int((labels == y).sum())) for y in (-1, 1)}
    slack = np.array([often[y] * 2 / (2 * COST * len(rows)) for y in labels])
    norms = np.array([(x * x).sum() + 1 for _, x in rows], float)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            (at, x), y = rows[i], labels[i]
            gradient = y * (w[at] @ x + bias) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (norms[i] + slack[i]))
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y * x
                bias += (new - alpha[i]) * y
                alpha[i] = new
    return w, bias


class Model:
    """The machines: one a family against the others, and one for each pair of languages in a family."""

    def __init__(self, langs: list[str], machines: dict[str, tuple[np.ndarray, float]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family(lang), []).append(lang)
        self.names = sorted(self.families)
        none = np.zeros(BUCKETS), 0.0
        self.outer = self._stacked([machines.get(_problem(None, f), none) for f in self.names])
        self.pairs = {f: list(itertools.combinations(own, 2)) for f, own in self.families.items()}
        self.inner = {f: self._stacked([machines.get(_problem(*p), none) for p in pairs]) for f, pairs in self.pairs.items()}

    @staticmethod
    def _stacked(machines: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
        weights = np.array([w for w, _ in machines], np.float32).reshape(-1, BUCKETS)
        return weights.T.copy(), np.array([b for _, b in machines])

    def predict(self, text: str) -> tuple[str, float]:
        """The language, and a score of 0 to 1: how clear its family is, times how clear it is within it."""
        if not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = features(text)
        margins = x @ self.outer[0][at] + self.outer[1]
        best = int(margins.argmax())
        score = _sure(margins[best] - np.delete(margins, best).max()) if len(margins) > 1 else 1.0
        own = self.families[self.names[best]]
        if len(own) == 1:
            return own[0], score
        pairs, (weights, bias) = self.pairs[self.names[best]], self.inner[self.names[best]]
        votes, sums = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        found = dict(zip(pairs, (x @ weights[at] + bias).tolist()))
        for (a, b), margin in found.items():
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        lang = max(own, key=lambda k: (votes[k], sums[k], k))
        return lang, score * _sure(min(2 * (m if lang == a else -m) for (a, b), m in found.items() if lang in (a, b)))


def _sure(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, 2 * margin))))


def _problem(a: str | None, b: str) -> str:
    """Name of a machine: of a family (a is None), or of two languages."""
    return f"{'' if a is None else len(a)}:{'' if a is None else a}:{b}"


def sample(docs: DataFrame) -> DataFrame:
    """lang, rank (from 1, in the language) and text of the labelled texts that may be learned from, TRAIN_ROWS a language at
    most: those with the least hashes. Equal texts of a language are one."""
    known = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"])).select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("h"))
    counts = materialize(known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts")), "languages")
    share = F.col("texts") * F.lit(1.0)
    drawn = known.join(counts, "lang").filter(F.pmod("h", F.lit(1 << 30)) * share <= F.lit(1.5 * TRAIN_ROWS * (1 << 30)))
    one = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).filter(F.col("rank") <= TRAIN_ROWS)


def fit(docs: DataFrame) -> Model:
    """The machines, each trained in a task on its part of the sample."""
    spark = docs.sparkSession

    @F.pandas_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]))
    def vectors(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t) for t in texts], columns=["at", "x"])

    rows = materialize(sample(docs).repartition(partitions(spark), "h").select("lang", "rank", "h", vectors("text").alias("v")), "language-sample")
    langs = [r["lang"] for r in rows.select("lang").distinct().collect()]
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(family(lang), []).append(lang)
    of = [(lang, _problem(None, f), 1 if family(lang) == f else -1, max(20, FAMILY_ROWS // len(langs))) for f in families for lang in langs if len(families) > 1]
    of += [(lang, _problem(a, b), 1 if lang == a else -1, TRAIN_ROWS) for own in families.values() for a, b in itertools.combinations(own, 2) for lang in (a, b)]
    problems = spark.createDataFrame(of, "lang string, problem string, label int, most int")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "rank"], ignore_index=True)
        w, bias = support_vector_machine([(np.asarray(a), np.asarray(x)) for a, x in zip(pdf["at"], pdf["x"])], pdf["label"].to_numpy())
        return pd.DataFrame({"problem": pdf["problem"][:1], "w": [w.astype("<f4").tobytes()], "bias": [bias]})

    parts = rows.join(F.broadcast(problems), "lang").filter(F.col("rank") <= F.col("most")).select("problem", "lang", "rank", "label", "v.at", "v.x")
    made = materialize(parts.groupBy("problem").applyInPandas(train, "problem string, w binary, bias double"), "language-machines")
    return Model(langs, {r["problem"]: (np.frombuffer(bytes(r["w"]), "<f4"), r["bias"]) for r in made.collect()})


def identify(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred and score.

    Learned from are text and non-null lang of documents that aren't held out (crc32 of doc_id mod 4 is 2), TRAIN_ROWS
    different texts a language at most; a prediction reads the text alone. A null text, or one without a letter, is
    "und" with score 0, and so is everything if nothing could be learned. Texts are read whole, however long; ties go to
    the last language by name; repeated rows and null doc_ids stay; an empty table gives no rows; other columns are not read.

    To the driver come the languages and a machine (64 KB) for each family and each pair of languages in one: how much
    that is depends on the languages, not on the rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.value.predict(t if isinstance(t, str) else "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "held_out": pdf["held_out"], "lang_pred": [f for f, _ in found], "score": [float(s) for _, s in found]})

    kind = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text").mapInPandas(run, kind)

"""Quality rules by n-gram perplexity (operator 9).

A modified Kneser-Ney model of character 4-grams for each language. Spark counts the 4-grams of all documents and derives
the lower orders, discounts and probabilities as joins and aggregates; the model is kept in arrays sorted by the n-gram's
hash. Documents whose perplexity is outside their language's band are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

ORDER = 4
#: Bits of a code point; an n-gram is two longs, (first, second) and (third, fourth) code point, lower orders with zeros.
BITS = 21
MASK = (1 << BITS) - 1
#: Characters counted or scored at once; n-grams of its partition that a task holds before it passes them on.
CHUNK, HELD = 1 << 17, 1 << 19
#: n-grams of a model that is broadcast (16 bytes each); a larger one is joined. Languages whose bands are broadcast.
MODEL_ROWS, BAND_ROWS = 4_000_000, 20_000
#: Bands: half width in nats is SPREADS robust deviations, LEAST at least, plus SLACK / sqrt(characters) for short texts.
SPREADS, LEAST, SLACK = 6.0, 0.15, 3.0
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
JUNK = "#*$%&|<>"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: what it counts as (lower case; one digit, one white space), and whether it is a letter or digit."""
    fold, alnum = np.arange(0x110000, dtype=np.int64), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isspace():
            fold[cp] = 32
        elif c.isdigit():
            fold[cp] = 48
        elif len(low := c.lower()) == 1:
            fold[cp] = ord(low)
        alnum[cp] = c.isalnum()
    return fold, alnum


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Lists of (text number, piece) of about CHUNK characters. A piece starts with three characters of context and
    the last of a text ends with an edge; long texts are cut in several."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):
            before = text[at - 3 : at] if at >= 3 else "\0\0\0"
            body = text[at : at + CHUNK]
            held.append((i, before + body + ("\0" if at + CHUNK >= len(text) else "")))
            size += len(body) + 4
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _grams(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-grams that end at each character of the joined pieces, as their two longs; the text of each, -1 where a
    piece's context is."""
    raw = "".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass")
    c = _tables()[0][np.frombuffer(raw, "<u4")]
    pair = c.copy()
    pair[1:] += c[:-1] << BITS
    a = np.zeros_like(pair)
    a[2:] = pair[:-2]
    lengths = np.fromiter((len(p) for _, p in pieces), np.int64, len(pieces))
    text = np.repeat(np.fromiter((i for i, _ in pieces), np.int64, len(pieces)), lengths)
    starts = np.cumsum(lengths) - lengths
    for k in range(3):
        text[starts + k] = -1
    return a, pair, text


def _mixed(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of n-grams."""
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + b.astype(np.uint64)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def _lang(langs: pd.Series) -> list[str]:
    return ["" if x is None or x != x else str(x) for x in langs]


def _by_lang(texts: pd.Series, langs: pd.Series) -> dict[str, tuple[list[int], list[str]]]:
    out: dict[str, tuple[list[int], list[str]]] = {}
    for i, (text, lang) in enumerate(zip(texts, _lang(langs))):
        rows, own = out.setdefault(lang, ([], []))
        rows.append(i)
        own.append(text if isinstance(text, str) else "")
    return out


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of several (hash, a, b, n) one, with each n-gram once."""
    h, a, b, n = (np.concatenate(x) for x in zip(*parts))
    at = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[at][1:] != h[at][:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at][first], a[at][first], b[at][first], np.add.reduceat(n[at], first) if len(h) else n


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, a, b, n of the 4-grams of a partition; those of a language that are held too many go on at once."""
    held: dict[str, list] = {}

    def flush(lang: str) -> pd.DataFrame:
        _, a, b, n = _summed(held.pop(lang))
        return pd.DataFrame({"lang": lang, "a": a, "b": b, "n": n})

    for pdf in batches:
        for lang, (_, texts) in _by_lang(pdf["text"], pdf["lang"]).items():
            for pieces in _pieces(texts):
                a, b, text = _grams(pieces)
                a, b = a[text >= 0], b[text >= 0]
                parts = held.setdefault(lang, [])
                parts.append(_summed([(_mixed(a, b, ORDER), a, b, np.ones(len(a), np.int64))]))
                if len(parts) > 1 and sum(len(x[0]) for x in parts[1:]) > len(parts[0][0]):
                    held[lang] = [_summed(parts)]
        while sum(len(x[0]) for parts in held.values() for x in parts) > HELD:
            yield flush(max(held, key=lambda k: sum(len(x[0]) for x in held[k])))
    for lang in list(held):
        yield flush(lang)


def kneser_ney(counted: DataFrame) -> dict[int, DataFrame]:
    """The interpolated modified Kneser-Ney model of counted 4-grams (lang, a, b, n), by order: lang, a, b, p (of the
    last character after those before) and, from order 2 on, of what is seen with a context (lang, a, b without the last
    character): rest, the share that goes to the order below.

    Lower orders count in how many contexts an n-gram is seen. Below order 1 all characters seen, and one more, are alike.
    """
    zero = F.lit(0).cast("long")
    types = {ORDER: counted}
    for order, (a, b) in {3: (F.col("a").bitwiseAND(MASK), F.col("b")), 2: (zero, F.col("b")), 1: (zero, F.col("b").bitwiseAND(MASK))}.items():
        suffixes = types[order + 1].select("lang", a.alias("a"), b.alias("b"))
        types[order] = materialize(suffixes.groupBy("lang", "a", "b").agg(F.count("*").alias("n")), f"kneser-ney-types-{order}")
    of = lambda k: F.sum((F.col("n") == k).cast("double")).alias(f"n{k}")
    out: dict[int, DataFrame] = {}
    for order in range(1, ORDER + 1):
        t = types[order]
        often = t.groupBy("lang").agg(*[of(k) for k in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        d = [F.when(F.col(f"n{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05 * k)), F.lit(float(k)))).otherwise(k * 0.5).alias(f"d{k}") for k in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(often.select("lang", "kinds", *d), "lang").withColumn("cut", cut)
        # the context: all but the last character
        t = t.withColumns({"ca": F.col("a"), "cb": F.shiftright("b", BITS)})
        contexts = t.groupBy("lang", "ca", "cb").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("rest"))
        t = t.join(contexts, ["lang", "ca", "cb"])
        if order == 1:
            below = 1 / (F.col("kinds") + 1)
        else:
            suffix = {4: (F.col("a").bitwiseAND(MASK), F.col("b")), 3: (zero, F.col("b")), 2: (zero, F.col("b").bitwiseAND(MASK))}[order]
            t = t.withColumns({"sa": suffix[0], "sb": suffix[1]}).join(out[order - 1].select("lang", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("below")), ["lang", "sa", "sb"])
            below = F.col("below")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("rest") * below
        out[order] = materialize(t.select("lang", "a", "b", "ca", "cb", p.alias("p"), "rest"), f"kneser-ney-{order}")
    return out


class Model:
    """-ln p of the 4-grams of each language, in arrays sorted by hash. It is fitted on the texts that it scores, so that
    each is there; of one that isn't (another text's) p is FLOOR."""

    FLOOR = 1e-6

    def __init__(self, parts: list[tuple[str, bytes, bytes]]):
        """parts: see packed()."""
        held: dict[str, list[tuple[bytes, bytes]]] = {}
        for lang, h, cost in parts:
            held.setdefault(lang, []).append((h, cost))
        self.arrays: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, own in held.items():
            h, cost = np.frombuffer(b"".join([x[0] for x in own]), "<u8"), np.frombuffer(b"".join([x[1] for x in own]), "<f4")
            at = np.argsort(h)
            self.arrays[lang] = h[at], cost[at]

    @staticmethod
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """lang, and the hashes and costs of n-grams (lang, a, b, p) as bytes: what comes to the driver is 12 bytes each."""
        for pdf in batches:
            for lang, own in pdf.groupby("lang", sort=False):
                h, cost = _mixed(own["a"].to_numpy(), own["b"].to_numpy(), ORDER), -np.log(own["p"].to_numpy())
                yield pd.DataFrame({"lang": [lang], "h": [h.astype("<u8").tobytes()], "cost": [cost.astype("<f4").tobytes()]})

    def cost(self, lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h, cost = self.arrays.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        asked, where = np.unique(_mixed(a, b, ORDER), return_inverse=True)
        at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
        found = np.full(len(asked), -np.log(self.FLOOR))
        if len(h):
            hit = h[at] == asked
            found[hit] = cost[at[hit]]
        return found[where]


def _log_ppl(model: Model, texts: pd.Series, langs: pd.Series) -> np.ndarray:
    """The sum of costs of each text."""
    out = np.zeros(len(texts))
    for lang, (rows, own) in _by_lang(texts, langs).items():
        sums = np.zeros(len(own))
        for pieces in _pieces(own):
            a, b, text = _grams(pieces)
            real = text >= 0
            sums += np.bincount(text[real], model.cost(lang, a[real], b[real]), len(own))
        out[rows] = sums
    return out


def _letters(text: str) -> int:
    """Letters and digits of a text, one at least: what a text's cost is divided by. Marks cost but don't dilute."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + int(_tables()[1][raw].sum())


def _base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")) if n else 0
    symbols = sum(map(text.count, JUNK))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        roll = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
        _, which, often = np.unique(roll, return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[which] > 1)
        if len(at):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_letters")
_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _counts(texts: list[str]) -> list[tuple[int, ...]]:
    return [(*_base(t), len(t), _letters(t)) for t in texts]


def _texts(texts: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in texts]


def _scored(docs: DataFrame, model_rows: int) -> DataFrame:
    """row (struct of all columns but an unwanted text), lang, the counts and cost (-ln of the text's probability)."""
    spark = docs.sparkSession
    counted = materialize(docs.select("text", "lang").mapInPandas(_count, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "n-grams")
    top = kneser_ney(counted)[ORDER].select("lang", "a", "b", "p")
    if counted.count() <= model_rows:
        parts = top.mapInPandas(Model.packed, "lang string, h binary, cost binary")
        model = spark.sparkContext.broadcast(Model([(r["lang"], bytes(r["h"]), bytes(r["cost"])) for r in parts.toLocalIterator()]))

        @F.pandas_udf(T.StructType([*_COUNTS.fields, T.StructField("cost", T.DoubleType())]))
        def score(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(_counts(_texts(texts)), columns=list(COUNTS)).assign(cost=_log_ppl(model.value, texts, langs))

        return docs.select("row", "lang", score("text", "lang").alias("s")).select("row", "lang", "s.*")

    @F.pandas_udf(_COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_counts(_texts(texts)), columns=list(COUNTS))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, text, lang in zip(pdf["number"], _texts(pdf["text"]), _lang(pdf["lang"])):
                for pieces in _pieces([text]):
                    a, b, of = _grams(pieces)
                    a, b = a[of >= 0], b[of >= 0]
                    _, a, b, n = _summed([(_mixed(a, b, ORDER), a, b, np.ones(len(a), np.int64))])
                    yield pd.DataFrame({"number": number, "lang": lang, "a": a, "b": b, "n": n})

    # numbers of written rows don't change when a task is run again
    numbered = materialize(docs.withColumn("number", F.monotonically_increasing_id()), "numbered")
    costs = numbered.select("number", "text", "lang").mapInPandas(grams, "number long, lang string, a long, b long, n long").join(top, ["lang", "a", "b"])
    # costs in the precision of the packed model
    sums = costs.groupBy("number").agg(F.sum(-F.col("n") * F.log("p").cast("float").cast("double")).alias("cost"))
    return numbered.join(sums, "number").select("row", "lang", count("text").alias("s"), "cost").select("row", "lang", "s.*", "cost")


def _medians(rows: DataFrame, value: Column) -> DataFrame:
    """lang, mid: the median of value in steps of 0.001 (the lower of two). A row a language and step is all that is sorted."""
    steps = rows.groupBy("lang", F.rint(value * 1000).cast("long").alias("step")).count()
    w = Window.partitionBy("lang").orderBy("step")
    so_far, every = F.sum("count").over(w), F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return steps.select("lang", "step", (2 * so_far >= every).alias("over")).filter("over").groupBy("lang").agg((F.min("step") / 1000).alias("mid"))


def judge(docs: DataFrame, keep: list[str] | None = None, model_rows: int = MODEL_ROWS) -> DataFrame:
    """row (a struct of the columns ``keep`` of docs, of all if not given) and v (a struct of n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ppl, kept) for each row of docs (text and, if there, lang).
    The model and the bands are fitted on these same rows.

    kept is false if a base rule fails or the log perplexity (a letter or digit) is outside the language's band. Null
    text counts as empty: no words, so the base rule fails. A null or missing lang is a language of its own, the same as
    an empty one. Repeated rows count and are judged alike. Texts are read whole, long ones in pieces. An empty table
    gives no rows. Columns stay in their struct, so that any name will do.

    A model of over model_rows n-grams is not broadcast: each document's distinct n-grams are joined to it. Bands of up
    to BAND_ROWS languages are broadcast.
    """
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    own = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), docs["text"].alias("text"), lang.alias("lang"))
    rows = materialize(_scored(own, model_rows).withColumn("log_ppl", F.col("cost") / F.col("n_letters")).drop("cost"), "perplexities")
    mids = materialize(_medians(rows, F.col("log_ppl")), "medians")
    small = mids.count() <= BAND_ROWS
    held = lambda bands: F.broadcast(bands) if small else bands
    off = rows.select("lang", "log_ppl").join(held(mids), "lang")
    spreads = materialize(_medians(off, F.abs(F.col("log_ppl") - F.col("mid"))).select("lang", (1.4826 * F.col("mid")).alias("spread")).join(mids, "lang"), "bands")
    width = F.greatest(SPREADS * F.col("spread"), F.lit(LEAST)) + SLACK / F.sqrt(F.col("n_chars") + 1)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.abs(F.col("log_ppl") - F.col("mid")) <= width)
    return rows.join(held(spreads), "lang").select("row", F.struct(*COUNTS[:5], failed.alias("base_failed"), "log_ppl", kept.alias("kept")).alias("v"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    return judge(docs).filter("v.kept").select("row.*")

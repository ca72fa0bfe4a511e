"""Similarity of sets, strings and numbers of a pair. All are symmetric in their two sides."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import char_grams, let, normalize_code, normalize_text, split_values, words

SET_METRICS = ("common", "jaccard", "dice", "containment")


def set_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Common members, Jaccard, Dice and containment of two arrays without repeats; shares of nothing are 1."""
    common, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    share = lambda n, d: F.when(d == 0, 1.0).otherwise(n.cast("double") / d)
    return {"common": common.cast("double"), "jaccard": share(common, na + nb - common), "dice": share(2 * common, na + nb), "containment": share(common, F.least(na, nb))}


def median_and_difference(a: Column, b: Column) -> dict[str, Column]:
    return {"median": (a + b) / F.lit(2.0), "absolute_difference": F.abs(a - b).cast("double")}


def minmax_ratio(a: Column, b: Column) -> Column:
    """min / max; 1 when both are 0."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b).cast("double") / F.greatest(a, b))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-8))


def numbers(c: Column) -> Column:
    """Numbers in a text, comma or point decimals, as an array of double."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def numeric_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Of the pair of numbers with the least relative difference: exact, similarity (ratio), relative_difference."""
    return of_numbers(numbers(a), numbers(b))


def of_numbers(own: Column, others: Column) -> dict[str, Column]:
    """numeric_metrics() of numbers()."""
    each = lambda x, y: F.struct(relative_difference(x, y).alias("d"), F.when(F.greatest(F.abs(x), F.abs(y)) == 0, 1.0).otherwise(F.least(F.abs(x), F.abs(y)) / F.greatest(F.abs(x), F.abs(y))).alias("r"))
    best = let(others, lambda ys: F.array_min(F.flatten(F.transform(own, lambda x: F.transform(ys, lambda y: each(x, y))))))
    d, r = F.coalesce(best["d"], F.lit(1.0)), F.coalesce(best["r"], F.lit(0.0))
    return {"exact": (d <= 1e-8).cast("double"), "similarity": r, "relative_difference": d}


def set_value_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Values split at ; , | and normalised: exact, similarity (Jaccard), dice, containment."""
    return of_sets(split_values(a), split_values(b))


def of_sets(x: Column, y: Column) -> dict[str, Column]:
    """set_value_metrics() of split_values()."""
    m = set_metrics(x, y)
    exact = (F.array_sort(x) == F.array_sort(y)) & (F.size(x) > 0)
    return {"exact": exact.cast("double"), "similarity": m["jaccard"], "dice": m["dice"], "containment": m["containment"]}


def text_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Mean of the Jaccard of words and of character trigrams."""
    x, y = normalize_text(a), normalize_text(b)
    return of_texts(x, y, text_words(x), text_words(y), char_grams(x), char_grams(y))


def text_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))


def of_texts(x: Column, y: Column, words1: Column, words2: Column, grams1: Column, grams2: Column) -> dict[str, Column]:
    """text_metrics() of normalised texts, their words and trigrams."""
    token = set_metrics(words1, words2)["jaccard"]
    char = set_metrics(grams1, grams2)["jaccard"]
    return {"exact": ((x == y) & (x != "")).cast("double"), "similarity": (token + char) / 2, "token_jaccard": token, "char_jaccard": char}


@F.pandas_udf(T.DoubleType())
def best_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Greatest Ratcliff-Obershelp ratio over all pairs of two arrays of strings; 0 without pairs."""
    for lefts, rights in batches:
        yield pd.Series([greatest_ratio(x, y) for x, y in zip(lefts, rights)], dtype=float)


def greatest_ratio(x, y) -> float:
    return max((SequenceMatcher(None, a, b).ratio() for a in x for b in y), default=0.0) if x is not None and y is not None else 0.0


def code_values(c: Column) -> Column:
    """The normalised codes in a value, without repeats."""
    return F.array_distinct(F.filter(F.transform(split_values(c), normalize_code), lambda x: x != ""))


def code_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Codes of two values: exact (one in common), set_exact, digit_exact (digits of one in common), jaccard,
    containment. The similarity is best_ratio of code_values, an Arrow UDF: no built-in computes it."""
    x, y = code_values(a), code_values(b)
    return of_codes(x, y, code_digits(x), code_digits(y))


def code_digits(codes: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(codes, lambda v: F.regexp_replace(v, r"\D", ""))), lambda v: v != "")


def of_codes(x: Column, y: Column, digits1: Column, digits2: Column) -> dict[str, Column]:
    """code_metrics() of code_values() and their digits."""
    m = set_metrics(x, y)
    return {
        "exact": F.arrays_overlap(x, y).cast("double"),
        "set_exact": ((F.array_sort(x) == F.array_sort(y)) & (F.size(x) > 0)).cast("double"),
        "digit_exact": F.arrays_overlap(digits1, digits2).cast("double"),
        "jaccard": m["jaccard"],
        "containment": m["containment"],
    }


def word_kinds(text: Column) -> dict[str, Column]:
    """Distinct lower-case words of a text: all, those with a digit, and those with a digit and a letter."""
    every = F.array_distinct(words(F.lower(text)))
    numeric = F.filter(every, lambda w: w.rlike(r"\d"))
    return {"all": every, "numeric": numeric, "model_code": F.filter(numeric, lambda w: w.rlike(r"\p{L}"))}


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def evidence_adjusted(p: Column, evidence: Column, coefficient: float) -> Column:
    """1 / (1 + exp(logit(1 - p) + evidence * coefficient))."""
    return 1 / (1 + F.exp(logit(1 - p) + evidence * coefficient))


#: What each sign of a conflict between two cards adds to the log odds of "no match".
EVIDENCE = (
    ("numeric_token_conflict", 0.2140903622),
    ("model_code_token_conflict", -0.3722740710),
    ("conflicting_common_attribute_values", -0.1632695198),
    ("name_char_trigrams_jaccard", -0.1526790708),
    ("name_words_containment", -0.7561550736),
    ("article_tokens_containment", -0.1195358336),
)


def card_evidence() -> list[Column]:
    """The signs, 0 to 1, from the columns of pair_features(): conflicts as they are, conflicting values as a share of five,
    words and trigrams by what they lack, articles by having none in common."""
    whole = lambda name: F.col(name).cast("double")
    of = {"conflicting_common_attribute_values": lambda n: F.least(whole(n), F.lit(5.0)) / 5, "name_char_trigrams_jaccard": lambda n: 1 - whole(n), "name_words_containment": lambda n: 1 - whole(n), "article_tokens_containment": lambda n: (whole(n) == 0).cast("double")}
    return [of.get(name, whole)(name) for name, _ in EVIDENCE]


def adjusted_by_cards(p: Column) -> Column:
    """A probability with the evidence of the cards' conflicts added: p and the log odds are kept off their ends."""
    no = F.least(F.greatest(1 - p, F.lit(1e-7)), F.lit(1 - 1e-7))
    score = logit(no)
    for sign, (_, weight) in zip(card_evidence(), EVIDENCE):
        score = score + sign * weight
    return 1 / (1 + F.exp(F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0))))

"""Text and attribute functions as columns; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row; a column inside a lambda is computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))


def squash(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form; Spark has no built-in. Apply before normalize_text to text that is not in it."""
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


#: Text that lower() and the compatibility form leave as casefold() would: ASCII and Russian letters.
PLAIN = r"^[\x00-\x7Fа-яёА-ЯЁ]*$"


@F.pandas_udf(ATTRIBUTES)
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    fold = lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold()
    for s in batches:
        yield s.map(lambda own: None if own is None else [{"k": fold(a["k"]), "v": fold(a["v"])} for a in own])


def folded_attributes(attrs: Column) -> Column:
    """Attributes in Unicode's compatibility form with case folded (ﬁ as fi, ß as ss), of which Spark has neither. Those of
    PLAIN text alone, which lower() serves as well, aren't handed to Python."""
    odd = F.exists(attrs, lambda a: ~F.coalesce(a["k"], F.lit("")).rlike(PLAIN) | ~F.coalesce(a["v"], F.lit("")).rlike(PLAIN))
    return F.coalesce(_folded(F.when(odd, attrs)), attrs)


def normalize_text(c: Column) -> Column:
    """Lower case, ё as е, white space collapsed; null as empty."""
    return squash(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"))


def normalize_key(c: Column) -> Column:
    return F.btrim(normalize_text(c), F.lit(" :;,.-"))


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), "[^0-9a-zа-я]", "")


def alnum_text(c: Column) -> Column:
    """Lower case; all but Latin and Cyrillic letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^а-яёa-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_spans(c: Column) -> Column:
    """Words with inner . / + - ' kept together."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+(?:[./+\-']\w+)*"), F.lit(0))


def char_grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text's characters with white space collapsed; a shorter text is one, an empty text none."""
    chars = F.filter(F.split(squash(F.coalesce(c, F.lit(""))), ""), lambda x: x != "")

    def grams(cs: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))
        return F.when(F.size(cs) >= n, F.array_distinct(many)).when(F.size(cs) > 0, F.array(F.array_join(cs, ""))).otherwise(F.array().cast("array<string>"))

    return let(chars, grams)


def alnum_grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text's letters and digits alone."""
    return char_grams(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", ""), n)


def split_values(c: Column) -> Column:
    """Distinct normalised values of a text split at ; , and |, in order."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\s*[;,|]+\s*")
    return F.array_distinct(F.filter(F.transform(parts, normalize_text), lambda x: x != ""))


def clip(c: Column, n: int) -> Column:
    """The first n characters, and an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def attributes(c: Column) -> Column:
    """A JSON object as an array of (k, v) in order: nulls as empty, the last of equal keys wins. Not an object: null.

    from_json keeps repeated keys and their order; nested values come as JSON text.
    """
    entries = F.transform(F.map_entries(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == e["k"]))

    return let(entries, last)


@F.pandas_udf(T.ArrayType(ATTRIBUTES.elementType))
def strict_attributes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As attributes(), with values as Python's str() gives them (True, nested objects); not an object: null."""

    def parse(text):
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            return None
        return [{"k": k, "v": "" if v is None else str(v)} for k, v in found.items()] if isinstance(found, dict) else None

    for s in batches:
        yield s.map(parse)


def lenient(original: Column, parsed: Column) -> Column:
    """parsed, or the original text where there is none."""
    return F.coalesce(parsed, original)


def group_attributes(attrs: Column) -> Column:
    """Attributes of equal normalised key as one, their distinct normalised values joined by ``;``, in order."""
    clean = F.filter(F.transform(attrs, lambda a: F.struct(normalize_key(a["k"]).alias("k"), normalize_text(a["v"]).alias("v"))), lambda a: (a["k"] != "") & (a["v"] != ""))

    def grouped(attrs: Column) -> Column:
        values = lambda k: F.array_join(F.array_distinct(F.transform(F.filter(attrs, lambda a: a["k"] == k), lambda a: a["v"])), ";")
        return F.transform(F.array_distinct(F.transform(attrs, lambda a: a["k"])), lambda k: F.struct(k.alias("k"), values(k).alias("v")))

    return let(clean, grouped)


def merge_missing(extracted: Column, own: Column) -> Column:
    """Extracted attributes whose key the card does not have (in any case), then the card's own."""
    names = F.transform(own, lambda a: F.lower(a["k"]))
    return F.concat(F.filter(extracted, lambda a: ~F.array_contains(names, F.lower(a["k"]))), own)


def serialize(name: Column, attrs: Column, style: str = "plain") -> Column:
    """A card as text: ``name k: v k: v`` or, in style "markers", ``name [KEY] k [VAL] v``."""
    one = (lambda a: F.concat(F.lit("[KEY] "), a["k"], F.lit(" [VAL] "), a["v"])) if style == "markers" else (lambda a: F.concat(a["k"], F.lit(": "), a["v"]))
    return F.concat_ws(" ", name, F.array_join(F.transform(attrs, one), " "))


def prompted(left: Column, right: Column) -> Column:
    return F.concat(F.lit("question:"), left, F.lit("\n\npassage:"), right)


def pack_fields(attrs: Column, budget: int, skip_oversized: bool = False) -> Column:
    """The whole attributes that fit ``budget`` words in order: up to the first that does not fit or, with
    skip_oversized, all that still fit when their turn comes."""
    cost = lambda a: F.size(words(F.concat_ws(" ", a["k"], a["v"])))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast(ATTRIBUTES).alias("kept"))

    def step(s: Column, a: Column) -> Column:
        fits = (s["used"] + cost(a) <= budget) & ~s["full"]
        return F.struct(
            F.when(fits, s["used"] + cost(a)).otherwise(s["used"]).alias("used"),
            (s["full"] | (F.lit(not skip_oversized) & ~fits)).alias("full"),
            F.when(fits, F.concat(s["kept"], F.array(a))).otherwise(s["kept"]).alias("kept"),
        )

    return F.aggregate(attrs, start, step, lambda s: s["kept"])


def shortest_first(attrs: Column) -> Column:
    """Attributes by their number of words, then as they stand."""
    sized = F.transform(attrs, lambda a, i: F.struct(F.size(words(F.concat_ws(" ", a["k"], a["v"]))).alias("n"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(sized), lambda s: s["a"])


def iso_time(clock: Column | None = None) -> Column:
    """A time (now, if none is given, as tests do) in UTC as ISO 8601."""
    at = F.to_utc_timestamp(F.current_timestamp() if clock is None else clock, F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def is_experiment_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")

"""Noise for training pairs: words and attributes left out, words in another order, typing slips. In Spark's own
functions; each draw is a seeded key of the row and the place, so a rerun makes the same noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import require_columns, seeded_key, uniform
from ..functions.text import let, words

#: The rows of two keyboard layouts; a slip hits a key beside the right one.
KEYBOARDS = (
    ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"),
    ("1234567890-=", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю."),
)


def _beside() -> dict[str, str]:
    """The keys beside each key, in all layouts."""
    out: dict[str, set[str]] = {}
    for row in {row for layout in KEYBOARDS for row in layout}:
        for a, b in zip(row, row[1:]):
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return {k: "".join(sorted(v)) for k, v in out.items()}


def _draw(seed: int, what: str, *parts: Column) -> Column:
    """A number in (0, 1] for a place of a row."""
    return uniform(seeded_key(seed, F.lit(what), *parts))


def without_some(items: Column, seed: int, what: str, probability: float, *row: Column) -> Column:
    """An array without the items drawn with ``probability``."""
    return F.filter(items, lambda _, i: _draw(seed, what, *row, i) > probability)


def drop_words(text: Column, seed: int, probability: float, *row: Column) -> Column:
    """The words of a text, as an array, without some; one stays at least."""

    def of(w: Column) -> Column:
        left = without_some(w, seed, "word", probability, *row)
        last = F.slice(F.array_sort(F.transform(w, lambda x, i: F.struct((-_draw(seed, "word", *row, i)).alias("d"), x.alias("w")))), 1, 1)
        return F.when(F.size(w) < 2, w).otherwise(let(left, lambda k: F.when(F.size(k) > 0, k).otherwise(F.transform(last, lambda s: s["w"]))))

    return let(words(text), of)


def shuffle_words(w: Column, seed: int, probability: float, *row: Column) -> Column:
    """An array of words, with ``probability`` in another order (turned by one if the draw gives the same)."""
    mixed = lambda w: F.transform(F.array_sort(F.transform(w, lambda x, i: F.struct(seeded_key(seed, F.lit("order"), *row, i).alias("k"), x.alias("w")))), lambda s: s["w"])
    turned = lambda w: F.concat(F.slice(w, F.lit(2), F.size(w)), F.slice(w, 1, 1))
    other = lambda w: let(mixed(w), lambda m: F.when(m == w, turned(w)).otherwise(m))
    return let(w, lambda w: F.when((F.size(w) > 1) & (_draw(seed, "shuffle", *row) <= probability), other(w)).otherwise(w))


def slips(text: Column, seed: int, probability: float, *row: Column) -> Column:
    """A text in which letters and signs are, with ``probability`` each, those of a key beside; case stays."""
    beside = F.create_map(*[F.lit(x) for kv in sorted(_beside().items()) for x in kv])

    def of(c: Column, i: Column) -> Column:
        near = F.element_at(beside, F.lower(c))
        pick = F.substring(near, F.pmod(seeded_key(seed, F.lit("key"), *row, i), F.char_length(near)).cast("int") + 1, F.lit(1))
        hit = near.isNotNull() & (_draw(seed, "slip", *row, i) <= probability)
        return F.when(hit, F.when(F.lower(c) != c, F.upper(pick)).otherwise(pick)).otherwise(c)

    return F.when(F.char_length(text) > 0, F.array_join(F.transform(F.split(text, ""), of), "")).otherwise(text)


def noisy(text: Column, seed: int, words: float, shuffle: float, slip: float, *row: Column) -> Column:
    """A text with words left out, in another order, and with slips; null stays null."""
    return F.when(text.isNotNull(), slips(F.array_join(shuffle_words(drop_words(text, seed, words, *row), seed, shuffle, *row), " "), seed, slip, *row))


def add_noise(rows: DataFrame, seed: int, pair: float = 1.0, attribute: float = 0.1, words: float = 0.1, shuffle: float = 0.1, slip: float = 0.01) -> DataFrame:
    """Pairs (pair_row, name_1, name_2, attributes_1, attributes_2 and others) with noise in, on average, a share ``pair``
    of them: attributes left out, and noise in names and the values of the attributes that stay. Names of attributes and
    all other columns are left alone. Another seed, as for each epoch, makes other noise."""
    require_columns(rows, "pair_row", "name_1", "name_2", "attributes_1", "attributes_2")
    hit = _draw(seed, "pair", F.col("pair_row")) <= pair
    new = {}
    for side in ("1", "2"):
        row = (F.col("pair_row"), F.lit(side))
        name, kept = F.col(f"name_{side}"), without_some(F.col(f"attributes_{side}"), seed, "attribute", attribute, *row)
        values = F.transform(kept, lambda a, i: F.struct(a["k"].alias("k"), noisy(a["v"], seed, words, shuffle, slip, *row, i).alias("v")))  # noqa: B023
        new |= {f"name_{side}": F.when(hit, noisy(name, seed, words, shuffle, slip, *row)).otherwise(name), f"attributes_{side}": F.when(hit, values).otherwise(F.col(f"attributes_{side}"))}
    return rows.withColumns(new)

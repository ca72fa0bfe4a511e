"""Pair assembly and pair features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as sim
from ..functions.identity import require_columns, seeded_key
from ..functions.text import ATTRIBUTES, alnum_grams, char_grams, folded_attributes, group_attributes, let, normalize_text, split_values, squash
from .numbering import with_row_number

#: What attribute names tell of their type, by substring, in this order of precedence.
CODE_MARKERS = ("артикул", "oem", "оем", "part number", "партномер", "номер детали", "номер модели", "модель", "код модели", "код товара", "код производителя", "sku")
PHYSICAL_MARKERS = (
    "вес", "масса", "длина", "ширина", "высота", "глубина", "толщина", "диаметр", "объем", "объём", "мощность", "напряжение", "частота", "давление", "температура", "скорость",
    "площадь", "емкость", "ёмкость",
)
NUMERIC_MARKERS = ("количество", "год", "число", "номер")
SET_MARKERS = ("цвет", "материал", "комплектация", "совместим", "назначение", "сезон", "покрытие", "тип", "вид", "форма", "бренд", "производитель", "страна")
OEM_MARKERS = ("oem", "оем")
MODEL_CODE_MARKERS = tuple(m for m in CODE_MARKERS if m not in OEM_MARKERS)
BRAND_MARKERS = ("бренд", "brand", "производитель")
ARTICLE_KEYS = ("артикул", "article", "sku", "код товара", "код модели")
TYPES = ("CODE", "PHYSICAL", "NUMERIC", "SET", "TEXT")


def with_pair_row(matches: DataFrame, *order: str) -> DataFrame:
    """Adds pair_row (0, 1, ...) in a declared total order, default id1, id2 and the rest."""
    order = order or tuple(matches.columns)
    return with_row_number(matches, "pair_row", *order)


def referenced(items: DataFrame, matches: DataFrame) -> DataFrame:
    """The items that matches refer to: a semi-join, so the rest of the items never reaches the pair joins."""
    ids = matches.select(F.explode(F.array("id1", "id2")).alias("id"))
    return items.join(ids, "id", "left_semi")


def assemble(items: DataFrame, matches: DataFrame, columns: tuple[str, ...] = ("name", "category", "attributes"), known: bool = False, wide: bool = False) -> DataFrame:
    """matches with <column>_1 and <column>_2 of both items; rows and repeats stay; an unknown item leaves nulls. With
    ``known`` it is an error, found as the rows are read. ``wide`` columns go by beside()."""
    require_columns(items, "id", *columns)
    cards = items.select("id", *columns) if wide else referenced(items, matches).select("id", *columns)
    side = lambda k: cards.select(F.col("id").alias(f"id{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    both = (lambda x, y: beside(matches, x, y, "left")) if wide else (lambda x, y: matches.join(x, "id1", "left").join(y, "id2", "left"))
    if not known:
        return both(side(1), side(2))
    there = lambda k: side(k).withColumn(f"_known{k}", F.lit(True))
    joined = both(there(1), there(2))
    sound = lambda k: F.when(F.col(f"_known{k}"), F.col(f"id{k}")).otherwise(F.raise_error(F.concat(F.lit("unknown item: "), F.coalesce(F.col(f"id{k}").cast("string"), F.lit("null")))))
    return joined.withColumns({"id1": sound(1), "id2": sound(2)}).drop("_known1", "_known2")


#: Parts of the right side's ids that wide cards meet in: a left card goes to each of them that has pairs of it, once.
PARTS = 16
#: Parts of the left side's ids: a right card goes to each of them, and PARTS * SIDES tasks share the pairs.
SIDES = 4


def beside(matches: DataFrame, left: DataFrame, right: DataFrame, how: str = "inner", widen: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """matches with the columns of ``left`` by id1 and of ``right`` by id2, for columns that are too wide to be shuffled with each
    pair.

    The pairs of an item with a part of the other items travel as one row, so its columns are shuffled PARTS times at most,
    however many pairs it has, and those of the other side SIDES times. Both sides are hashed, which needs no order and spills
    nothing: a task holds a PARTS-th of ``right``, and its own share of ``left``. ``widen`` makes of columns that were shuffled
    those that are returned: once for each of those rows, not for each pair.
    """
    part = lambda c, n: F.pmod(F.xxhash64(c.cast("string")), F.lit(n)).cast("int")
    others = [c for c in matches.columns if c != "id1"]
    ways = lambda columns: {c: make(F.col(c)) for c, make in (widen or {}).items() if c in columns}
    grouped = matches.groupBy("id1", (part(F.col("id1"), SIDES) * PARTS + part(F.col("id2"), PARTS)).alias("_part")).agg(F.collect_list(F.struct(*others)).alias("_pairs"))
    own, new = [c for c in left.columns if c != "id1"], [c for c in right.columns if c != "id2"]
    one = grouped.join(left.hint("shuffle_hash"), "id1", how).repartitionById(PARTS * SIDES, "_part").withColumns(ways(own)).withColumn("_pair", F.explode("_pairs"))
    rows = one.select("_part", "id1", *own, *[F.col(f"_pair.{c}").alias(c) for c in others])
    two = right.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1)))).withColumn("_part", F.col("_side") * PARTS + part(F.col("id2"), PARTS)).drop("_side")
    found = rows.join(two.repartitionById(PARTS * SIDES, "_part").withColumns(ways(new)).hint("shuffle_hash"), ["_part", "id2"], how)
    return found.select(*matches.columns, *own, *new)


def joined(values: Column) -> Column:
    """An array of texts without line breaks as one text, null as a blank: a fraction of an array's bytes."""
    return F.array_join(F.concat(F.array(F.lit("")), values), "\n", " ")


def parted(text: Column) -> Column:
    """The array that joined() had, but for nulls, which are blanks."""
    return F.slice(F.split(text, "\n"), F.lit(2), F.lit(1 << 30))


#: Up to so many attributes are put in order by generated code, which has a term for each place; more by lambdas, which Spark
#: interprets at about three times the price.
PLACES = 8


def shuffle_attributes(pairs: DataFrame, copies: int, seed: int) -> DataFrame:
    """Each row ``copies`` times (copy), the attributes of both sides in an order of their own by seeded hash: by the 12 hex
    digits of seeded_key(seed, id1, id2, copy, side, place), whose order as text is that of the number, then by place."""
    out = pairs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    own = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("id1", "id2", "copy")])
    place = lambda start, i: F.struct(F.substring(F.md5(F.concat(start, i.cast("string"))), 1, 12).alias("h"), i.alias("i"))
    starts, orders, shuffled = {}, {}, {}
    for side in (1, 2):
        attributes, start, order = F.col(f"attributes_{side}"), F.col(f"_start{side}"), F.col(f"_order{side}")
        n, few = F.size(attributes), F.size(attributes) <= PLACES
        each = F.array(*[F.when(n > i, place(start, F.lit(i))) for i in range(PLACES)])
        starts[f"_start{side}"] = F.concat(own, F.lit(f"|{side}|"))
        orders[f"_order{side}"] = F.sort_array(F.when(few, F.slice(each, F.lit(1), n)).otherwise(let(start, lambda h: F.transform(attributes, lambda _, i: place(h, i)))))
        taken = F.array(*[F.get(attributes, F.get(order, F.lit(i))["i"]) for i in range(PLACES)])
        shuffled[f"attributes_{side}"] = F.when(few, F.slice(taken, F.lit(1), n)).otherwise(F.transform(order, lambda o: F.get(attributes, o["i"])))  # noqa: B023
    return out.withColumns(starts).withColumns(orders).withColumns(shuffled).drop(*starts, *orders)


def sort_by_priority(cards: DataFrame, priorities: DataFrame) -> DataFrame:
    """cards (id, category, attributes) with attributes by priority of their category, else the global one; attributes
    without one keep their order at the end. priorities: scope, category, attribute, priority; a small table."""
    rows = cards.select("id", "category", F.posexplode("attributes").alias("i", "a"))
    own = priorities.filter("scope = 'category'").select("category", F.col("attribute").alias("key"), F.col("priority").alias("own"))
    every = priorities.filter("scope = 'global'").select(F.col("attribute").alias("key"), F.col("priority").alias("every"))
    ranked = rows.withColumn("key", F.lower("a.k")).join(own, ["category", "key"], "left").join(every, "key", "left")
    place = F.coalesce("own", "every", F.lit(2**31 - 1)).alias("p")
    found = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place, "i", "a"))).alias("s"))
    return cards.join(found, "id", "left").withColumn("attributes", F.coalesce(F.transform("s", lambda x: x["a"]), F.array().cast(ATTRIBUTES))).drop("s")


def validate_priorities(priorities: DataFrame) -> DataFrame:
    """Priorities of 1 at least, non-empty attributes, each once; else an error."""
    require_columns(priorities, "scope", "category", "attribute", "priority")
    bad = priorities.filter("priority < 1 or trim(attribute) = '' or attribute is null or scope not in ('global', 'category')")
    twice = priorities.groupBy("scope", "category", "attribute").count().filter("count > 1")
    if not bad.isEmpty() or not twice.isEmpty():
        raise ValueError("priorities hold a wrong or repeated row")
    return priorities


def _has(key: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(m)) for m in markers])


def attribute_type(key: Column, left: Column, right: Column) -> Column:
    """CODE, PHYSICAL, NUMERIC or SET by the name; SET if a value holds ; or |; else TEXT."""
    return F.coalesce(_type_by_name(key), F.when(F.coalesce(_listed(left), F.lit(False)) | F.coalesce(_listed(right), F.lit(False)), "SET").otherwise("TEXT"))


def _type_by_name(key: Column) -> Column:
    return F.when(_has(key, CODE_MARKERS), "CODE").when(_has(key, PHYSICAL_MARKERS), "PHYSICAL").when(_has(key, NUMERIC_MARKERS), "NUMERIC").when(_has(key, SET_MARKERS), "SET")


def _listed(value: Column) -> Column:
    return value.rlike("[;|]")


def critical_group(key: Column) -> Column:
    return F.when(_has(key, OEM_MARKERS), "oem").when(_has(key, MODEL_CODE_MARKERS), "model_code").when(_has(key, BRAND_MARKERS), "brand")


def attribute_views(attrs: Column) -> Column:
    """What comparisons need of a card's attributes, once a card and not once a pair: of each name its value, its type by name
    (null: by the values) and what values of that type are compared by."""

    def view(a: Column) -> Column:
        def typed(named: Column) -> Column:
            v, code, text = a["v"], named == "CODE", named.isNull()
            plain = normalize_text(v)
            sets = {"codes": F.when(code, sim.code_values(v)), "digits": F.when(code, sim.code_digits(sim.code_values(v))), "values": F.when(text | (named == "SET"), split_values(v)), "words": F.when(text, sim.text_words(plain)), "grams": F.when(text, char_grams(plain))}
            numbers = F.when(named.isin("PHYSICAL", "NUMERIC"), sim.numbers(v))
            return F.struct(a["k"].alias("k"), v.alias("v"), named.alias("named"), _listed(v).alias("listed"), critical_group(a["k"]).alias("critical"), F.when(text, plain).alias("text"), numbers.alias("numbers"), *[c.alias(name) for name, c in sets.items()])

        return let(_type_by_name(a["k"]), typed)

    return F.transform(group_attributes(folded_attributes(attrs)), view)


def _compared(x: Column, y: Column) -> Column:
    """An array with a struct for each name on either side of two attribute_views(), but for the similarity of codes: theirs are
    in codes_1 and codes_2, ordered by value."""
    empty = F.array().cast("array<string>")

    def row(a: Column, type_: Column, both: bool, exact: Column, similarity: Column, digit_exact: Column, codes: tuple[Column, Column]) -> Column:
        return F.struct(a["k"].alias("name"), type_.alias("type"), F.lit(both).alias("both_present"), exact.alias("exact"), similarity.alias("similarity"), digit_exact.alias("digit_exact"), codes[0].alias("codes_1"), codes[1].alias("codes_2"), a["critical"].alias("critical"))

    def alone(a: Column) -> Column:
        return row(a, F.coalesce(a["named"], F.when(a["listed"], "SET").otherwise("TEXT")), False, F.lit(0.0), F.lit(0.0), F.lit(0.0), (empty, empty))

    def together(a: Column, b: Column) -> Column:
        named = F.coalesce(a["named"], F.when(a["listed"] | b["listed"], "SET").otherwise("TEXT"))

        def of_type(t: Column) -> Column:
            of = lambda f, *names: f(*[side[c] for c in names for side in (a, b)])
            code, number, listed, text = of(sim.of_codes, "codes", "digits"), of(sim.of_numbers, "numbers"), of(sim.of_sets, "values"), of(sim.of_texts, "text", "words", "grams")
            value = lambda m, c: F.when(t == "CODE", c).when(t.isin("PHYSICAL", "NUMERIC"), number[m]).when(t == "SET", listed[m]).otherwise(text[m])
            first = a["v"] <= b["v"]
            codes = tuple(F.when(t != "CODE", empty).when(f, a["codes"]).otherwise(b["codes"]) for f in (first, ~first))
            return row(a, t, True, value("exact", code["exact"]), value("similarity", F.lit(0.0)), F.when(t == "CODE", code["digit_exact"]).otherwise(0.0), codes)

        return let(named, of_type)

    def joined_rows(x: Column, y: Column) -> Column:
        same = lambda a: F.get(F.filter(y, lambda b: b["k"] == a["k"]), F.lit(0))
        own = F.transform(x, lambda a: let(same(a), lambda b: F.when(b.isNull(), alone(a)).otherwise(together(a, b))))
        return F.concat(own, F.transform(F.filter(y, lambda b: ~F.exists(x, lambda a: a["k"] == b["k"])), alone))

    none = F.array().cast(VIEWS)
    return joined_rows(F.coalesce(x, none), F.coalesce(y, none))


VIEWS = "array<struct<k:string,v:string,named:string,listed:boolean,critical:string,text:string,numbers:array<double>,codes:array<string>,digits:array<string>,values:array<string>,words:array<string>,grams:array<string>>>"


def compare_attributes(pairs: DataFrame, key: str = "pair_row") -> DataFrame:
    """A row for each attribute name on either side of a pair (attributes_1 and _2, arrays of (k, v)): key, type,
    both_present, one_missing, exact, similarity, conflict, group. Symmetric in the sides but for the code similarity,
    whose sides are ordered before it is computed."""
    views = pairs.select(key, *[attribute_views(F.col(f"attributes_{k}")).alias(f"_{k}") for k in (1, 2)])
    rows = views.select(key, F.explode(_compared(F.col("_1"), F.col("_2"))).alias("c")).select(key, "c.*")
    # the one measure without a built-in runs on the rows that have codes; the others give it empty arrays
    rows = rows.withColumn("code_similarity", sim.best_ratio("codes_1", "codes_2"))
    code = F.col("both_present") & (F.col("type") == "CODE")
    rows = rows.withColumn("similarity", F.when(code, F.col("code_similarity")).otherwise(F.col("similarity")))
    conflict = F.col("both_present") & (F.col("exact") == 0) & ((F.col("similarity") < 0.5) | (code & (F.col("digit_exact") == 0)))
    return rows.select(key, "name", "type", "both_present", (~F.col("both_present")).alias("one_missing"), "exact", "similarity", conflict.cast("double").alias("conflict"), "critical")


CRITICAL = ("model_code", "oem", "brand")
#: The names of the numbers of a pair's comparisons: 5 totals, 7 for each type, 4 for each critical group.
TYPED = (
    *(f"typed_attribute_{c}" for c in ("comparisons", "both_present", "one_missing", "exact_matches", "strong_conflicts")),
    *(f"typed_{t.lower()}_{c}" for t in TYPES for c in ("comparisons", "both_present", "one_missing", "exact_matches", "mean_similarity", "min_similarity", "strong_conflicts")),
    *(f"typed_{g}_{c}" for g in CRITICAL for c in ("both_present", "exact_match", "conflict", "one_missing")),
)


def _counted(at: np.ndarray, n: int, of: pa.StructArray, similarity: np.ndarray, conflict: np.ndarray) -> np.ndarray:
    """A row for each of n pairs with the numbers named in TYPED, from all their comparisons, which are of the pairs ``at``."""
    kinds, groups = len(TYPES), len(CRITICAL)
    place = lambda c, names: pc.fill_null(pc.index_in(of.field(c), value_set=pa.array(names)), -1).to_numpy(zero_copy_only=False)
    present, exact = (of.field(c).to_numpy(zero_copy_only=False) for c in ("both_present", "exact"))
    exactly, against = present & (exact > 0), present & (conflict > 0)
    every, one, kind, group = np.ones(len(at), bool), np.zeros(len(at), int), place("type", TYPES), place("critical", CRITICAL)

    def sums(those: np.ndarray, of: np.ndarray, width: int, weights: np.ndarray | None = None) -> np.ndarray:
        """A row a pair, a column a kind."""
        keep = those & (of >= 0)
        return np.bincount(at[keep] * width + of[keep], None if weights is None else weights[keep], n * width).reshape(n, width).astype(float)

    totals = [sums(every, one, 1), sums(present, one, 1), sums(~present, one, 1), sums(every, one, 1, exact), sums(every, one, 1, conflict)]
    held, least = sums(present, kind, kinds), np.full(n * kinds, np.inf)
    np.minimum.at(least, (at * kinds + kind)[present], similarity[present])
    mean = sums(present, kind, kinds, similarity) / np.maximum(held, 1)
    by_type = [sums(every, kind, kinds), held, sums(~present, kind, kinds), sums(exactly, kind, kinds), mean, np.where(np.isinf(least), 0.0, least).reshape(n, kinds), sums(against, kind, kinds)]
    by_group = [np.minimum(sums(those, group, groups), 1) for those in (present, exactly, against, ~present)]
    return np.hstack([*totals, *(np.stack(x, axis=2).reshape(n, -1) for x in (by_type, by_group))])


def _judged(of: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """similarity and conflict of _compared() rows; that of codes, which has no built-in, is computed here."""
    present, exact, similarity, digits = (of.field(c).to_numpy(zero_copy_only=False) for c in ("both_present", "exact", "similarity", "digit_exact"))
    code, similarity = present & pc.equal(of.field("type"), "CODE").to_numpy(zero_copy_only=False), similarity.copy()
    codes = (of.field(c).take(pa.array(np.flatnonzero(code))).to_pylist() for c in ("codes_1", "codes_2"))
    similarity[code] = [sim.greatest_ratio(x, y) for x, y in zip(*codes)]
    return similarity, (present & (exact == 0) & ((similarity < 0.5) | (code & (digits == 0)))).astype(float)


def _with_typed(rows: DataFrame, comparisons: str, judged: bool) -> DataFrame:
    """rows with the columns named in TYPED in place of an array of comparisons, ``judged`` ones or _compared() ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(comparisons)
            at = np.repeat(np.arange(len(own)), pc.fill_null(own.value_lengths(), 0).to_numpy(zero_copy_only=False))
            flat = own.flatten()
            values = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("similarity", "conflict")] if judged else _judged(flat)
            numbers = _counted(at, len(own), flat, *values)
            rest = [c for c in batch.schema.names if c != comparisons]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(np.ascontiguousarray(x)) for x in numbers.T)], [*rest, *TYPED])

    kept = rows.drop(comparisons).schema.fields
    return rows.mapInArrow(counted, T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in TYPED)]))


def typed_features(comparisons: DataFrame, key: str = "pair_row") -> DataFrame:
    """52 features of a pair from its comparisons: 5 totals, 7 for each type, 4 for each critical group."""
    one = F.struct("type", "both_present", "exact", "similarity", "conflict", "critical")
    return _with_typed(comparisons.groupBy(key).agg(F.collect_list(one).alias("_all")), "_all", judged=True)


def card_features(items: DataFrame, *more: Column) -> DataFrame:
    """What pair features need of a card, once a card and not once a pair: lengths, digit counts and token sets; and ``more``
    columns of items."""
    low = lambda c: squash(F.lower(c))
    attrs = F.transform("attributes", lambda a: F.struct(low(a["k"]).alias("k"), low(a["v"]).alias("v")))
    rows = items.select("id", "category", F.coalesce("name", F.lit("")).alias("name"), attrs.alias("attrs"), *more)
    further = rows.columns[4:]
    # of equal names the last value counts, in the place of the first
    rows = rows.withColumn("attrs", F.transform(F.array_distinct(F.transform("attrs", lambda a: a["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter("attrs", lambda a: a["k"] == k), -1)["v"].alias("v"))))
    rows = rows.withColumn("attributes", F.array_join(F.transform("attrs", lambda a: F.concat_ws(" ", a["k"], a["v"])), " "))
    rows = rows.withColumn("card", F.concat_ws(" ", "name", "attributes"))
    out: dict[str, Column] = {}
    for field in ("name", "attributes", "card"):
        out[f"{field}_chars"] = F.length(field).cast("double")
        out[f"{field}_words"] = F.size(F.filter(F.split(field, r"(?U)\s+"), lambda w: w != "")).cast("double")
        for kind, tokens in sim.word_kinds(F.col(field)).items():
            if kind == "all" or field == "card":
                out[f"{field}_{kind}"] = tokens
    out["digits"] = F.regexp_count("card", F.lit(r"\d")).cast("double")
    for d in range(10):
        out[f"digit_{d}"] = F.regexp_count("card", F.lit(str(d))).cast("double")
    out["name_low"] = F.lower("name")
    out["trigrams"] = alnum_grams(F.col("name"))
    out["keys"] = F.transform("attrs", lambda a: a["k"])
    out["values"] = F.array_distinct(F.transform("attrs", lambda a: a["v"]))
    out["articles"] = F.array_distinct(F.transform(F.filter("attrs", lambda a: _has(a["k"], ARTICLE_KEYS)), lambda a: a["v"]))
    out["brand"] = F.coalesce(F.get(F.filter("attrs", lambda a: _has(a["k"], BRAND_MARKERS)), F.lit(0))["v"], F.lit(""))
    return rows.select("id", F.struct("category", "attrs", *[c.alias(k) for k, c in out.items()]).alias("f"), *further)


#: The numbers of card_features(), and its sets of texts that are shuffled.
COUNTS = (*(f"{field}_{unit}" for field in ("name", "attributes", "card") for unit in ("chars", "words")), "digits", *(f"digit_{d}" for d in range(10)))
SETS = ("name_all", "attributes_all", "card_numeric", "card_model_code", "trigrams", "articles")


def packed_card(f: Column) -> Column:
    """card_features() of a card in few bytes: sets as one text each, and none that follows from others. Its texts have no line
    breaks, and no value is a blank."""
    sets = [joined(f[c]).alias(c) for c in SETS]
    keys, values = (joined(f["attrs"][c]).alias(c) for c in "kv")
    return F.struct(f["category"].alias("category"), f["name_low"].alias("name_low"), f["brand"].alias("brand"), keys, values, *sets, F.array(*[f[c].cast("int") for c in COUNTS]).alias("n"))


def unpacked_card(p: Column) -> Column:
    """What pair_features() reads of a card, from packed_card()."""
    sets = {c: parted(p[c]) for c in (*SETS, "k", "v")}
    words = F.array_distinct(F.concat(sets["name_all"], F.coalesce(sets["attributes_all"], F.array().cast("array<string>"))))
    out = {c: p[c] for c in ("category", "name_low", "brand")} | {c: sets[c] for c in SETS} | {"card_all": words, "keys": sets["k"], "values": F.array_distinct(sets["v"]), "attrs": F.arrays_zip(sets["k"], sets["v"])}
    return F.struct(*[c.alias(name) for name, c in out.items()], *[F.get(p["n"], F.lit(i)).cast("double").alias(c) for i, c in enumerate(COUNTS)])


def pair_features(matches: DataFrame, cards: DataFrame) -> DataFrame:
    """matches with category and 84 numbers about each pair, equal if its sides change places. cards: card_features()."""
    side = lambda k, name: cards.select(F.col("id").alias(f"id{k}"), packed_card(F.col("f")).alias(name))
    rows = beside(matches, side(1, "x"), side(2, "y"), widen={"x": unpacked_card, "y": unpacked_card})
    return rows.select(*matches.columns, *[c.alias(k) for k, c in pair_columns().items()])


def pair_columns() -> dict[str, Column]:
    """The columns of pair_features() of two cards x and y."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    # a lambda among them keeps Spark from making one method of all columns, over the 8,000 bytes that the JVM compiles
    category = let(F.array(F.least("x.category", "y.category"), F.greatest("x.category", "y.category")), lambda two: F.when(x("category") == y("category"), x("category")).otherwise(F.concat_ws(" <> ", two)))
    out: dict[str, Column] = {"category": category}

    def two(name: str, c: str) -> None:
        out.update({f"{name}_{k}": v for k, v in sim.median_and_difference(x(c), y(c)).items()})

    def overlap(name: str, c: str) -> None:
        out.update({f"{name}_{k}": v for k, v in sim.set_metrics(x(c), y(c)).items()})

    for field in ("name", "attributes", "card"):
        two(f"{field}_chars", f"{field}_chars")
        two(f"{field}_words", f"{field}_words")
        for unit in {"name": ("chars", "words"), "card": ("words",)}.get(field, ()):
            out[f"{field}_{unit}_minmax_ratio"] = sim.minmax_ratio(x(f"{field}_{unit}"), y(f"{field}_{unit}"))
    two("digits_total", "digits")
    out["digits_total_minmax_ratio"] = sim.minmax_ratio(x("digits"), y("digits"))
    for d in range(10):
        two(f"digit_{d}", f"digit_{d}")
    for name, c in (("name_words", "name_all"), ("attribute_words", "attributes_all"), ("card_words", "card_all"), ("numeric_tokens", "card_numeric"), ("model_code_tokens", "card_model_code")):
        overlap(name, c)
    a, b = x("name_low"), y("name_low")
    out["exact_name"] = (a == b).cast("double")
    out["name_contains_other"] = ((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))).cast("double")
    out["model_code_overlap_present"] = (out["model_code_tokens_common"] > 0).cast("double")
    out["numeric_token_conflict"] = (out["numeric_tokens_containment"] == 0).cast("double")
    out["model_code_token_conflict"] = (out["model_code_tokens_containment"] == 0).cast("double")
    overlap("name_char_trigrams", "trigrams")
    for name, c in (("attribute_keys", "keys"), ("attribute_values", "values"), ("article_tokens", "articles")):
        overlap(name, c)
    common = F.size(F.array_intersect(x("keys"), y("keys")))
    exact = F.size(F.array_intersect(x("attrs"), y("attrs")))
    out["exact_common_attribute_values"] = exact.cast("double")
    out["conflicting_common_attribute_values"] = (common - exact).cast("double")
    out["exact_value_share_among_common_keys"] = F.when(common == 0, 1.0).otherwise(exact / common)
    out["conflict_share_among_common_keys"] = F.when(common == 0, 0.0).otherwise((common - exact) / common)
    out["brand_exact_match"] = ((x("brand") != "") & (x("brand") == y("brand"))).cast("double")
    return out


def all_features(matches: DataFrame, items: DataFrame) -> DataFrame:
    """pair_features() and typed_features() of matches (with pair_row): 137 columns besides those of matches."""
    cards = card_features(items, attribute_views(F.col("attributes")).alias("a"))
    side = lambda k, *names: cards.select(F.col("id").alias(f"id{k}"), packed_card(F.col("f")).alias(names[0]), F.col("a").alias(names[1]))
    # all of it within the row of a pair: its comparisons are not shuffled
    rows = beside(matches, side(1, "x", "_a"), side(2, "y", "_b"), widen={"x": unpacked_card, "y": unpacked_card})
    base = rows.select("pair_row", *[c for c in matches.columns if c != "pair_row"], *[c.alias(k) for k, c in pair_columns().items()], _compared(F.col("_a"), F.col("_b")).alias("_met"))
    return _with_typed(base, "_met", judged=False)


def signed_differences(matches: DataFrame, cards: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """matches with, for each number of a card, left minus right (the order of sides counts here)."""
    side = lambda k, name: cards.select(F.col("id").alias(f"id{k}"), F.struct(*[F.col(f"f.{c}").alias(c) for c in columns]).alias(name)).hint("shuffle_hash")
    rows = matches.join(side(1, "x"), "id1").join(side(2, "y"), "id2")
    return rows.select(*matches.columns, *[(F.col(f"x.{c}") - F.col(f"y.{c}")).alias(f"{c}_difference_1_2") for c in columns])

"""Units of measure in attribute names, values and product names, as column expressions over one table of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ATTRIBUTES, let, squash

#: Fixed values. For each quantity: its target unit; its units as (name, scale to the first unit's base, offset).
QUANTITIES: dict[str, tuple[str, dict[str, tuple[float, float]]]] = {
    "length": ("мм", {"нм": (1e-6, 0), "мкм": (1e-3, 0), "мм": (1, 0), "см": (10, 0), "дм": (100, 0), "м": (1e3, 0), "км": (1e6, 0), "дюйм": (25.4, 0), "ft": (304.8, 0)}),
    "mass": ("кг", {"мг": (1e-6, 0), "г": (1e-3, 0), "кг": (1, 0), "т": (1e3, 0), "lb": (0.45359237, 0), "oz": (0.028349523125, 0)}),
    "volume": ("л", {"мкл": (1e-6, 0), "мл": (1e-3, 0), "л": (1, 0), "см³": (1e-3, 0), "дм³": (1, 0), "м³": (1e3, 0)}),
    "area": ("м²", {"мм²": (1e-6, 0), "см²": (1e-4, 0), "м²": (1, 0)}),
    "time": ("с", {"мс": (1e-3, 0), "с": (1, 0), "мин": (60, 0), "ч": (3600, 0), "сут": (86400, 0)}),
    "power": ("вт", {"мвт": (1e-3, 0), "вт": (1, 0), "квт": (1e3, 0)}),
    "voltage": ("в", {"мв": (1e-3, 0), "в": (1, 0), "кв": (1e3, 0)}),
    "current": ("а", {"ма": (1e-3, 0), "а": (1, 0)}),
    "frequency": ("гц", {"гц": (1, 0), "кгц": (1e3, 0), "мгц": (1e6, 0), "ггц": (1e9, 0)}),
    "pressure": ("па", {"па": (1, 0), "кпа": (1e3, 0), "мпа": (1e6, 0), "бар": (1e5, 0), "атм": (101325, 0), "psi": (6894.757293168361, 0)}),
    "resistance": ("ом", {"ом": (1, 0), "ком": (1e3, 0), "мом": (1e6, 0)}),
    "energy": ("дж", {"дж": (1, 0), "кдж": (1e3, 0), "вт·ч": (3600, 0), "квт·ч": (3.6e6, 0)}),
    "temperature": ("°c", {"°c": (1, 0), "°с": (1, 0), "°f": (5 / 9, -160 / 9)}),
}
#: Words in an attribute name that tell its quantity.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "length": ("ширина", "высота", "длина", "глубина", "толщина", "диаметр", "радиус", "размер", "размеры", "габарит", "габариты", "периметр", "окружность", "клиренс", "дорожный просвет", "колея", "база", "размах", "ход", "шаг", "зазор"),
    "area": ("площадь",),
    "mass": ("вес", "масса"),
    "volume": ("объем", "объём", "резервуар", "бак"),
    "time": ("время", "длительность", "продолжительность"),
    "power": ("мощность",),
    "voltage": ("напряжение",),
    "current": ("ток", "сила тока"),
    "frequency": ("частота",),
    "pressure": ("давление",),
    "resistance": ("сопротивление",),
    "energy": ("энергия",),
    "temperature": ("температура",),
}
#: Other spellings of a unit.
ALIASES: dict[str, tuple[str, ...]] = {
    "мм": ("mm", "миллиметр", "миллиметра", "миллиметров"), "см": ("cm", "сантиметр", "сантиметра", "сантиметров"), "м": ("метр", "метра", "метров"), "дюйм": ("дюйма", "дюймов", "inch"),
    "г": ("гр", "грамм", "грамма", "граммов"), "кг": ("kg", "килограмм", "килограмма", "килограммов"), "л": ("литр", "литра", "литров"), "мл": ("ml", "миллилитр", "миллилитров"),
    "вт": ("w", "ватт", "ватта"), "квт": ("kw", "киловатт"), "в": ("v", "вольт"), "а": ("a", "ампер"), "гц": ("hz", "герц"), "с": ("сек", "секунд", "секунды"), "мин": ("минут", "минуты"), "ч": ("час", "часа", "часов"),
}
#: Names that hold codes, whose values are never measures.
SKIP = ("артикул", "oem", "оем", "sku", "part number", "partnumber", "партномер", "номер детали", "номер запчасти", "код товара", "код детали", "код производителя", "каталожный номер")
#: Units that are told apart from a value and named, but not converted, by the word in the attribute's name.
NAMED = {
    "высота": "u",
    "длина": "пог. м",
    "угол": "° | град | рад",
    "площадь": "кв. м | км² | кв. см | кв. мм | га | дм²",
    "вес": "карат",
    "нагрузка": "г | lb | кг | н | т | кгс | кн",
    "грузоподъемность": "lb | кг | т",
    "грузоподъёмность": "lb | кг | т",
    "сила": "мн | кгс | н | кн",
    "усилие": "мн | кгс | н | кн",
    "крутящий момент": "нм | кгс·м | lb-ft | н·м",
    "объем": "гб | кб | куб. м | куб. мм | куб. см | мб | мм³ | тб",
    "объём": "гб | кб | куб. м | куб. мм | куб. см | мб | мм³ | тб",
    "вместимость": "м³ | см³ | мл | комплектов | бутылок | л | шт | чел | листов | дм³",
    "емкость": "ач | вт·ч | гб | дм³ | квт·ч | л | м³ | мач | мб | мкл | мкф | мл | нф | пф | см³ | тб | ф | шт",
    "ёмкость": "ач | вт·ч | гб | дм³ | квт·ч | л | м³ | мач | мб | мкл | мкф | мл | нф | пф | см³ | тб | ф | шт",
    "время": "мкс | дни | месяцы",
    "продолжительность": "месяцы",
    "скорость": "iops | ips | гб/с | гбит/с | кадр/с | кб/с | кбит/с | км/ч | м/мин | м/с | мб/с | мбит/с | мм/с | об/мин | см/с | стежки/мин | стр/мин",
    "скорость вращения": "об/с | об/мин | rpm",
    "обороты": "об/с | об/мин | rpm",
    "число оборотов": "об/с | об/мин | rpm",
    "скорость передачи": "бит/с | байт/с",
    "пропускная способность": "байт/с | бит/с | гб/с | гбит/с | кб/с | кбит/с | мб/с | мбит/с",
    "битрейт": "гбит/с | мбит/с | кбит/с | бит/с",
    "расход": "г/мин | г/ч | кг/м² | кг/мин | кг/сут | кг/ч | л/кг | л/м² | л/мин | л/сут | л/ч | м³/мин | м³/сут | м³/ч | мл/мин | мл/ч",
    "производительность": "г/мин | г/ч | кг/мин | кг/сут | кг/ч | л/мин | л/ч | м³/мин | м³/сут | м³/ч | мл/мин | шт/мин | шт/ч",
    "расход воздуха": "л/с | cfm",
    "расход топлива": "л/100км",
    "воздушный поток": "м³/мин | л/с | м³/ч | cfm | л/мин",
    "мощность": "л.с. | ква | btu/h | ва",
    "ток": "ка | мка",
    "сила тока": "ка | мка",
    "заряд": "мккл | кл | мач | мкл | ач",
    "электрическая емкость": "мкф | нф | пф | мф | ф",
    "электрическая ёмкость": "мкф | нф | пф | мф | ф",
    "энергия": "мдж | ккал | кал",
    "энергопотребление": "вт·ч | квт·ч | квт·ч/год",
    "частота вращения": "об/с | об/мин",
    "частота кадров": "кадр/с | fps",
    "давление": "мбар | кгс/см² | мм рт. ст.",
    "память": "тб | гб | байт | мб | бит | кб",
    "накопитель": "тб | гб | мб",
    "разрядность": "бит",
    "битность": "бит",
    "световой поток": "лм",
    "освещенность": "лк",
    "освещённость": "лк",
    "яркость": "нит | кд/м²",
    "плотность": "г/мл | мг/мл | кг/л | г/см³ | г/л | кг/м³",
    "вязкость": "сст | па·с | cst | мпа·с",
    "твердость": "shore d | shore a | hv | hb | hrc",
    "твёрдость": "shore d | shore a | hv | hb | hrc",
    "процент": "%",
    "доля": "%",
    "концентрация": "мг/мл | моль/л | мг/л | г/л | %",
    "влажность": "%",
    "уровень шума": "дб | дба",
    "шум": "дб | дба",
}
#: Units that count at the end of a name, after a comma or in brackets, whatever it says.
EXPLICIT = ("мм", "см", "м", "дюйм", "мл", "л", "г", "кг", "гб", "мб", "%")
DIMENSIONS = ("размер", "размеры", "габариты")
NUMBER = r"\d+(?:[.,]\d+)?"
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _spellings(quantity: str) -> dict[str, str]:
    units = QUANTITIES[quantity][1]
    return {s: u for u in units for s in (u, *ALIASES.get(u, ()))}


def _any(values) -> str:
    return "|".join(sorted(map(_quote, values), key=len, reverse=True))


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?{}[]\|()" else c for c in s)


def _one_of(key: Column, names) -> Column:
    return key.rlike(f"(?iu){_B}(?:{_any(names)}){_E}")


def unit_of(text: Column, quantity: str) -> Column:
    """The first unit of a quantity in a text, by its canonical name; null if there is none."""
    spelling = F.lower(F.regexp_extract(text, f"(?iu){_B}({_any(_spellings(quantity))}){_E}", 1))
    table = F.create_map(*[F.lit(x) for kv in _spellings(quantity).items() for x in kv])
    return F.when(spelling != "", F.element_at(table, spelling))


def without_unit(text: Column, quantity: str) -> Column:
    pattern = f"(?iu)\\(?{_B}(?:{_any(_spellings(quantity))}){_E}\\)?"
    return F.btrim(squash(F.regexp_replace(text, pattern, "")), F.lit(" ,()"))


def converted(number: Column, unit: Column, quantity: str) -> Column:
    """A number in ``unit`` as one in the quantity's target unit."""
    units = QUANTITIES[quantity][1]
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for u, so in units.items() for x in (u, float(so[k]))]), unit)
    return number * pick(0) + pick(1)


def number_text(x: Column) -> Column:
    """A whole number without a point, others to 12 significant digits without trailing zeros; below 1e-4 and from 1e12
    on with an exponent (1.5e-05)."""
    return let(x, _number_text)


def _number_text(x: Column) -> Column:
    whole = F.abs(x - F.rint(x)) <= F.greatest(F.abs(x) * 1e-12, F.lit(1e-12))
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    power = F.floor(F.log10(F.abs(x))).cast("int")
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.lit(11) - power))
    plain = bare(F.format_string("%.15f", F.rint(x * scale) / scale))
    first = F.rint(x * F.pow(F.lit(10.0), F.lit(11) - power)) / 1e11
    carried = F.abs(first) >= 10  # 9.99... rounded up
    lead, power = F.when(carried, first / 10).otherwise(first), F.when(carried, power + 1).otherwise(power)
    exponent = F.concat(bare(F.format_string("%.11f", lead)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    small = (F.abs(x) < 1e-4) | (F.abs(x) >= 1e12)
    return F.when(whole & (F.abs(x) < 1e18), F.rint(x).cast("decimal(20,0)").cast("string")).when(small, exponent).otherwise(plain)


def _parsed(value: Column) -> Column:
    """A value that is a number and nothing else."""
    return F.when(value.rlike(rf"^[-+]?{NUMBER}$"), F.replace(value, F.lit(","), F.lit(".")).try_cast("double"))


def _named(k: Column, v: Column, same: Column) -> Column:
    """The attribute with its unit in the name, as "name, unit", by the first word of NAMED in the name one of whose units is
    in the value or else in the name; else by an EXPLICIT unit in the name; else as it is."""
    key, value = F.trim(k), F.trim(v)
    around = lambda units: f"(?isu)^(.*?){_B}({units}){_E}(.*)$"
    part = lambda text, pattern, i: F.call_function("regexp_extract", text, pattern, F.lit(i))  # noqa: E731  (the pattern is a column)
    rest = lambda text, pattern: F.concat(part(text, pattern, 1), part(text, pattern, 3))
    every = {s: u for units in (*NAMED.values(), " | ".join(EXPLICIT)) for u in units.split(" | ") for s in (u, *ALIASES.get(u, ()))}
    unit = lambda spelling: F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), F.lower(spelling))
    words = []
    for word, units in NAMED.items():
        spelled = _any([s for u in units.split(" | ") for s in (u, *ALIASES.get(u, ()))])
        words.append(F.struct(F.lit(f"(?iu){_B}{_quote(word)}{_E}").alias("word"), F.lit(around(spelled)).alias("unit"), F.lit(rf"(?iu)\(\s*(?:{spelled})\s*\)").alias("bracketed")))
    fits = lambda m: F.regexp_like(key, m["word"]) & (F.regexp_like(value, m["unit"]) | F.regexp_like(key, m["unit"]))

    def by_word(m: Column) -> Column:
        there = F.regexp_like(value, m["unit"])
        bare = F.regexp_replace(key, m["bracketed"], F.lit(""))
        bare = F.btrim(squash(F.when(F.regexp_like(bare, m["unit"]), rest(bare, m["unit"])).otherwise(bare)), F.lit(" ,()"))
        found = unit(part(F.when(there, value).otherwise(key), m["unit"], 2))
        return F.when(m.isNotNull(), F.struct(F.concat(bare, F.lit(", "), found).alias("k"), F.when(there, F.trim(rest(value, m["unit"]))).otherwise(value).alias("v")))

    at_end = rf"(?isu)^(.*?)(?:,\s*({_any(s for u in EXPLICIT for s in (u, *ALIASES.get(u, ())))})(?=$|\s)|\(\s*({_any(s for u in EXPLICIT for s in (u, *ALIASES.get(u, ())))})\s*\)).*$"

    def by_end(alias: Column) -> Column:
        mark = F.concat(F.lit(f"(?isu)^(.*?){_B}(\\Q"), alias, F.lit(f"\\E){_E}(.*)$"))
        without = F.when(F.regexp_like(value, mark), F.trim(rest(value, mark))).otherwise(value)
        return F.struct(F.concat(F.trim(F.regexp_extract(key, at_end, 1)), F.lit(", "), unit(alias)).alias("k"), without.alias("v"))

    named = let(F.get(F.filter(F.array(*words), fits), F.lit(0)), by_word)
    ended = F.when(key.rlike(at_end), let(F.concat(F.regexp_extract(key, at_end, 2), F.regexp_extract(key, at_end, 3)), by_end))
    return F.coalesce(F.when(_one_of(key, NAMED), named), ended, same)


def normalize_measure(k: Column, v: Column) -> Column:
    """An attribute as struct (k, v): name and unit as "name, target unit" and the value in that unit, if the name tells
    a quantity and its unit is in the value or the name; a unit that isn't converted is told apart and put in the name
    (see _named()); else as it is. Names of codes are left alone."""
    key, value = F.lower(F.trim(k)), F.trim(v)
    same = F.struct(F.trim(k).alias("k"), value.alias("v"))
    out = _named(k, v, same)

    def measured(quantity: str):
        target, name = QUANTITIES[quantity][0], without_unit(key, quantity)

        def of(m: Column) -> Column:
            done = lambda new: F.struct(F.concat(name, F.lit(f", {target}")).alias("k"), number_text(new).alias("v"))
            kept = F.struct(F.concat_ws(", ", name, m["unit"]).alias("k"), m["bare"].alias("v"))
            sound = lambda new: new.isNotNull() & (F.abs(new) < float("inf"))
            return let(converted(_parsed(m["bare"]), m["unit"], quantity), lambda new: F.when(sound(new), done(new)).otherwise(kept))

        return of

    for quantity in reversed(QUANTITIES):
        unit = F.coalesce(unit_of(value, quantity), unit_of(key, quantity))
        # bound once: within a lambda an expression is computed again wherever it stands
        own = let(F.struct(unit.alias("unit"), without_unit(value, quantity).alias("bare")), measured(quantity))
        out = F.when(_one_of(key, KEYWORDS[quantity]) & unit.isNotNull(), own).otherwise(out)
    return F.when(reduce(lambda a, b: a | b, [F.contains(key, F.lit(s)) for s in SKIP]), same).otherwise(out)


def split_dimensions(attrs: Column) -> Column:
    """``AxB[xC]`` under a name of dimensions, with a unit, as длина, ширина and высота of it; others stay."""
    size = rf"^\s*({NUMBER})\s*[xх×*]\s*({NUMBER})(?:\s*[xх×*]\s*({NUMBER}))?\s*$"

    def one(a: Column) -> Column:
        key, value = F.lower(F.trim(a["k"])), F.trim(a["v"])
        unit = F.coalesce(unit_of(value, "length"), unit_of(key, "length"))
        bare = without_unit(value, "length")
        suffix = F.regexp_extract(key, r"(?iu)размеры?\s+([а-яёa-z0-9_-]+)", 1)
        name = lambda n: F.concat(F.lit(n), F.when(suffix != "", F.concat(F.lit(" "), suffix)).otherwise(""), F.lit(", "), unit)
        part = lambda i: F.regexp_extract(bare, size, i)
        made = F.array(*[F.struct(name(n).alias("k"), part(i).alias("v")) for i, n in enumerate(("длина", "ширина", "высота"), 1)])
        fits = _one_of(key, DIMENSIONS) & (F.length(value) <= 20) & unit.isNotNull() & bare.rlike(size)
        return F.when(fits, F.filter(made, lambda x: x["v"] != "")).otherwise(F.array(F.struct(a["k"].alias("k"), a["v"].alias("v"))))

    return F.flatten(F.transform(attrs, one))


def rename_attributes(attrs: Column, names: Column) -> Column:
    """Attributes with names replaced by a map (lower-cased name to name); of names that become equal the first stays."""
    new = F.transform(attrs, lambda a: F.struct(F.coalesce(F.element_at(names, F.lower(a["k"])), a["k"]).alias("k"), a["v"].alias("v")))
    return F.filter(new, lambda a, i: ~F.exists(F.slice(new, 1, i), lambda o: o["k"] == a["k"]))


def normalize_attributes(attrs: Column, names: Column | None = None) -> Column:
    """Dimensions split, measures in target units, names by synonyms; null stays null."""
    out = F.transform(split_dimensions(attrs), lambda a: normalize_measure(a["k"], a["v"]))
    return out if names is None else rename_attributes(out, names)


def measures_in_name(name: Column) -> Column:
    """The measures in a product name as attributes: ``AxBxC unit`` as длина, ширина, высота; then a number and a unit,
    its name by its quantity, for lengths the last keyword before it. A year with "г" is no weight; the first value of a
    name counts. Values are in target units."""
    text = F.lower(F.coalesce(name, F.lit("")))
    lengths = _any(_spellings("length"))
    triple = rf"({NUMBER})\s*[xх×*]\s*({NUMBER})(?:\s*[xх×*]\s*({NUMBER}))?\s*({lengths})(?![a-zа-яё0-9])"
    rest = F.regexp_replace(text, triple, " ")
    boxes = F.regexp_extract_all(text, F.lit(triple), F.lit(0))

    def box(m: Column) -> Column:
        unit = unit_of(F.regexp_extract(m, triple, 4), "length")
        part = lambda i: F.regexp_extract(m, triple, i)
        all_three = F.array(*[F.struct(F.lit(n).alias("n"), part(i).alias("x"), unit.alias("u"), F.lit("length").alias("q")) for i, n in enumerate(("длина", "ширина", "высота"), 1)])
        return F.filter(all_three, lambda s: s["x"] != "")

    names = {"length": "длина", "mass": "вес", "volume": "объем", "power": "мощность", "voltage": "напряжение", "current": "сила тока", "frequency": "частота", "time": "время"}
    every = {s: q for q in names for s in _spellings(q)}
    single = rf"[^,;/|()]{{0,40}}?(?<![\p{{N}}.,])({NUMBER})(\s*)({_any(every)})(?![a-zа-яё0-9])"

    def measure(m: Column) -> Column:
        number, gap, spelling = (F.regexp_extract(m, single, i) for i in (1, 2, 3))
        quantity = F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), spelling)
        canonical = F.element_at(F.create_map(*[F.lit(x) for q in names for s, u in _spellings(q).items() for x in (s, u)]), spelling)
        word = F.element_at(F.concat(F.array(F.lit("длина")), F.regexp_extract_all(m, F.lit(f"(?iu){_B}({_any(KEYWORDS['length'])}){_E}"), F.lit(1))), -1)
        short = F.regexp_like(m, F.lit(r"(?:\bdia\s*|\bd\s*|[ø⌀]\s*)\d[\d.,]*\s*[^\d\s]+$"))
        default = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), quantity)
        called = F.when(quantity == "length", F.when((word == "длина") & short, "диаметр").otherwise(word)).otherwise(default)
        year = (spelling == "г") & (gap == "") & number.rlike(r"^(19\d\d|20\d\d|2100)$")
        return F.when(~year, F.struct(called.alias("n"), number.alias("x"), canonical.alias("u"), quantity.alias("q")))

    found = F.concat(F.flatten(F.transform(boxes, box)), F.filter(F.transform(F.regexp_extract_all(rest, F.lit(single), F.lit(0)), measure), lambda s: s.isNotNull()))
    number = lambda s: F.replace(s["x"], F.lit(","), F.lit(".")).cast("double")

    def final(s: Column) -> Column:
        value = reduce(lambda c, q: F.when(s["q"] == q, converted(number(s), s["u"], q)).otherwise(c), names, F.lit(None).cast("double"))
        target = F.element_at(F.create_map(*[F.lit(x) for q in names for x in (q, QUANTITIES[q][0])]), s["q"])
        return F.struct(F.concat_ws(", ", s["n"], target).alias("k"), number_text(value).alias("v"))

    done = F.transform(found, final)
    return F.filter(done, lambda a, i: ~F.exists(F.slice(done, 1, i), lambda o: o["k"] == a["k"])).cast(ATTRIBUTES)

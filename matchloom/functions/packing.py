"""Two cards packed into one token budget, whole attributes only, and the attribute that owns each token.

A card is a struct of what must be there (name and category) and its attributes as sections, each with its tokens. Both
cards start with half the budget; what one can't use goes to the other, and what is left after the whole attributes are
placed goes to the side that gains more, then to the other. A greedy choice never takes fewer tokens of a larger budget
(where two budgets first choose differently, the larger has passed the smaller), so those two steps end it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, words

#: From an array of texts to an array of their tokens. A Pandas UDF over arrays of strings will do.
Tokenizer = Callable[[Column], Column]
#: Special tokens of a pair: before the left card, between the cards, after the right one.
LAYOUTS = {"bert": (("[CLS]",), ("[SEP]",), ("[SEP]",)), "roberta": (("<s>",), ("</s>", "</s>"), ("</s>",))}


def word_tokens(texts: Column) -> Column:
    return F.transform(texts, words)


def card_texts(name: Column, category: Column, attrs: Column, style: str = "plain", value_chars: int | None = None) -> Column:
    """name, category, then a prefix and a value for each attribute, as one array to tokenise."""
    marked = style == "markers"
    field = lambda k, v: F.concat(F.lit("[KEY] "), k, F.lit(" [VAL] "), v) if marked else F.concat(k, F.lit(": "), v)
    prefix = lambda k: F.concat(F.lit("[KEY] "), k, F.lit(" [VAL]")) if marked else F.concat(k, F.lit(":"))
    value = lambda v: v if value_chars is None else F.left(v, F.lit(value_chars))
    own = F.flatten(F.transform(attrs, lambda a: F.array(prefix(a["k"]), F.concat(F.lit(" "), value(a["v"])))))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.array(field(F.lit("name"), empty(name)), field(F.lit("category"), empty(category))), F.coalesce(own, F.array().cast("array<string>")))


def card_sections(tokens: Column, attrs: Column, value_tokens: int | None = None, shortest: bool = True) -> Column:
    """struct(required, sections: array of (k, tokens)) from the tokens of card_texts(): sections by their number of
    tokens, then as they stand; without ``shortest`` as they stand."""
    value = lambda t: t if value_tokens is None else F.slice(t, 1, value_tokens)

    def built(t: Column) -> Column:
        one = lambda a, i: F.struct(a["k"].alias("k"), F.concat(F.get(t, 2 * i + 2), value(F.get(t, 2 * i + 3))).alias("tokens"))
        own = F.coalesce(F.transform(attrs, one), F.transform(F.slice(t, 1, 0), lambda x: F.struct(F.lit("").alias("k"), x.alias("tokens"))))
        if shortest:
            sized = F.array_sort(F.transform(own, lambda s, i: F.struct(F.size(s["tokens"]).alias("n"), i.alias("i"), s.alias("s"))))
            own = F.transform(sized, lambda s: s["s"])
        return F.struct(F.concat(F.get(t, 0), F.get(t, 1)).alias("required"), own.alias("sections"))

    return let(tokens, built)


def _costs(card: str) -> Column:
    return F.transform(f"{card}.sections", lambda s: F.size(s["tokens"]))


def _running(costs: Column) -> Column:
    """Sums of the first one, two, ... costs."""
    return F.aggregate(costs, F.array().cast("array<int>"), lambda sums, n: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + n)))


def _fitted(must: str, costs: str, sums: str, budget: Column, skip: bool) -> Column:
    """struct(used, kept): how many tokens of a card fit, and the places of its whole sections among them. What is required
    (``must`` tokens) comes first and is cut if it must be. Without ``skip`` the first section that doesn't fit ends it."""
    must = F.col(must)
    none = F.array().cast("array<int>")

    def first(b: Column) -> Column:
        """As many as fit from the first on."""
        n = F.when(must < b, F.size(F.filter(sums, lambda x: must + x <= b))).otherwise(0)
        used = F.least(must, b) + F.when(n > 0, F.element_at(F.col(sums), n)).otherwise(0)
        return F.struct(used.alias("used"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none).alias("kept"))

    def any_that_fits(b: Column) -> Column:
        start = F.struct(F.least(must, b).alias("used"), none.alias("kept"), F.lit(0).alias("i"))

        def step(s: Column, n: Column) -> Column:
            fits = (must < b) & (s["used"] + n <= b)
            return F.struct(F.when(fits, s["used"] + n).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(s["i"]))).otherwise(s["kept"]).alias("kept"), (s["i"] + 1).alias("i"))

        return F.aggregate(F.col(costs), start, step, lambda s: F.struct(s["used"].alias("used"), s["kept"].alias("kept")))

    return let(budget, any_that_fits if skip else first)


def pack_pairs(rows: DataFrame, budget: int, left: str = "left", right: str = "right", skip_oversized: bool = False) -> DataFrame:
    """rows with ``left_fit`` and ``right_fit``, structs of used and kept (see _fitted), whose tokens together are ``budget`` at
    most. A null card makes both null."""
    if budget < 1:
        raise ValueError("the budget must leave room for content")
    b = F.lit(budget)
    own = [f"_{side}{name}" for side in "lr" for name in ("must", "costs", "sums", "wants", "share", "1", "2", "3")]
    if taken := [c for c in own if c in rows.columns]:
        raise ValueError(f"columns in the way: {taken}")
    fit = lambda side, to: _fitted(f"_{side}must", f"_{side}costs", f"_{side}sums", to, skip_oversized)
    for side, card in (("l", left), ("r", right)):
        rows = rows.withColumns({f"_{side}must": F.size(f"{card}.required"), f"_{side}costs": _costs(card)})
        rows = rows.withColumns({f"_{side}sums": _running(F.col(f"_{side}costs"))})
        rows = rows.withColumns({f"_{side}wants": F.col(f"_{side}must") + F.aggregate(f"_{side}costs", F.lit(0), lambda n, x: n + x)})
    rows = rows.withColumns({"_lshare": F.least(F.col("_lwants"), F.lit((budget + 1) // 2)), "_rshare": F.least(F.col("_rwants"), F.lit(budget // 2))})
    spare = b - F.col("_lshare") - F.col("_rshare")
    extra = F.least(F.col("_lwants") - F.col("_lshare"), spare)
    rows = rows.withColumns({"_lshare": F.col("_lshare") + extra, "_rshare": F.col("_rshare") + F.least(F.col("_rwants") - F.col("_rshare"), spare - extra)})
    rows = rows.withColumns({"_l1": fit("l", F.col("_lshare")), "_r1": fit("r", F.col("_rshare"))})
    # the same cards with all that the other side leaves
    rows = rows.withColumns({"_l2": fit("l", b - F.col("_r1.used")), "_r2": fit("r", b - F.col("_l1.used"))})
    rows = rows.withColumns({"_l3": fit("l", b - F.col("_r2.used")), "_r3": fit("r", b - F.col("_l2.used"))})
    first = F.col("_l2.used") - F.col("_l1.used") >= F.col("_r2.used") - F.col("_r1.used")
    better = lambda own, new: F.when(F.col(f"{new}.used") > F.col(f"{own}.used"), F.col(new)).otherwise(F.col(own))
    rows = rows.withColumns({"left_fit": F.when(first, better("_l1", "_l2")).otherwise(better("_l1", "_l3")), "right_fit": F.when(first, better("_r1", "_r3")).otherwise(better("_r1", "_r2"))})
    return rows.drop(*own)


def shape(card: Column) -> Column:
    """A card with its numbers of tokens, but empty ones: all that packing depends on, alike in many cards."""
    blank = lambda tokens: F.array_repeat(F.lit(""), F.size(tokens))
    return F.when(card.isNotNull(), let(card, lambda c: F.struct(blank(c["required"]).alias("required"), F.transform(c["sections"], lambda s: F.struct(s["k"].alias("k"), blank(s["tokens"]).alias("tokens"))).alias("sections"))))


def fitted_card(card: Column, budget: int) -> Column:
    """struct of wants, used, kept, tokens, owners and keys: once a card, all that pairs of it need for any share of ``budget``
    where the first section that doesn't fit ends it. What a share lets in is then a start of tokens and owners."""

    def made(c: Column) -> Column:
        must = F.size(c["required"])
        costs = F.transform(c["sections"], lambda s: F.size(s["tokens"]))
        sums = F.aggregate(costs, F.array(must), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

        def whole(sums: Column) -> Column:
            shares = F.sequence(F.lit(0), F.lit(budget))
            # sums has what is required first; sections only follow if there is room behind it
            kept = F.transform(shares, lambda b: F.when(F.element_at(sums, 1) < b, F.size(F.filter(sums, lambda x: x <= b)) - 1).otherwise(0))
            used = F.transform(shares, lambda b: F.when(F.element_at(sums, 1) < b, F.array_max(F.filter(sums, lambda x: x <= b))).otherwise(b))
            tokens = F.concat(c["required"], F.flatten(F.transform(c["sections"], lambda s: s["tokens"])))
            owners = F.concat(F.transform(c["required"], lambda _: F.lit(None).cast("string")), F.flatten(F.transform(c["sections"], lambda s: F.transform(s["tokens"], lambda _: s["k"]))))
            return F.struct(F.element_at(sums, -1).alias("wants"), used.alias("used"), kept.alias("kept"), tokens.alias("tokens"), owners.alias("owners"), c["sections"]["k"].alias("keys"))

        return let(sums, whole)

    return F.when(card.isNotNull(), let(card, made))


def fit_pairs(rows: DataFrame, budget: int, left: str, right: str) -> DataFrame:
    """rows with ``left_share`` and ``right_share``, for which fitted_card() of each side has what pack_pairs() lets in: places in
    its used and kept. Shares are looked up, so generated code does all of it. A null card makes both null."""
    if budget < 1:
        raise ValueError("the budget must leave room for content")
    b, cards = F.lit(budget), {"l": left, "r": right}
    own = [f"_{side}{name}" for side in "lr" for name in ("wants", "share", "1", "2", "3")]
    used = lambda side, share: F.get(F.col(f"{cards[side]}.used"), share)
    rows = rows.withColumns({f"_{side}wants": F.col(f"{card}.wants") for side, card in cards.items()})
    rows = rows.withColumns({"_lshare": F.least(F.col("_lwants"), F.lit((budget + 1) // 2)), "_rshare": F.least(F.col("_rwants"), F.lit(budget // 2))})
    spare = b - F.col("_lshare") - F.col("_rshare")
    extra = F.least(F.col("_lwants") - F.col("_lshare"), spare)
    rows = rows.withColumns({"_lshare": F.col("_lshare") + extra, "_rshare": F.col("_rshare") + F.least(F.col("_rwants") - F.col("_rshare"), spare - extra)})
    rows = rows.withColumns({"_l1": used("l", F.col("_lshare")), "_r1": used("r", F.col("_rshare"))})
    # the same cards with all that the other side leaves
    rows = rows.withColumns({"_l2": used("l", b - F.col("_r1")), "_r2": used("r", b - F.col("_l1"))})
    rows = rows.withColumns({"_l3": used("l", b - F.col("_r2")), "_r3": used("r", b - F.col("_l2"))})
    first = F.col("_l2") - F.col("_l1") >= F.col("_r2") - F.col("_r1")
    better = lambda side, new, other: F.when(F.col(f"_{side}{new}") > F.col(f"_{side}1"), b - F.col(other)).otherwise(F.col(f"_{side}share"))
    rows = rows.withColumns({"left_share": F.when(first, better("l", 2, "_r1")).otherwise(better("l", 3, "_r2")), "right_share": F.when(first, better("r", 3, "_l2")).otherwise(better("r", 2, "_l1"))})
    known = F.col(f"{left}.wants").isNotNull() & F.col(f"{right}.wants").isNotNull()
    return rows.withColumns({c: F.when(known, F.col(c)) for c in ("left_share", "right_share")}).drop(*own)


def used_of(card: str, share: str) -> Column:
    """How many tokens of a fitted_card() are in."""
    return F.get(F.col(f"{card}.used"), F.col(share))


def kept_of(card: str, share: str) -> Column:
    """How many of its attributes."""
    return F.get(F.col(f"{card}.kept"), F.col(share))


def start_of(card: str, values: str, share: str) -> Column:
    """Its tokens or owners that are in."""
    return F.slice(F.col(f"{card}.{values}"), F.lit(1), used_of(card, share))


def fitted_tokens(card: str, fit: str) -> Column:
    own = F.flatten(F.transform(f"{fit}.kept", lambda i: F.get(F.col(f"{card}.sections"), i)["tokens"]))
    return F.concat(F.slice(f"{card}.required", F.lit(1), F.least(F.size(f"{card}.required"), F.col(f"{fit}.used"))), own)


def _fitted_keys(card: str, fit: str) -> Column:
    return F.transform(f"{fit}.kept", lambda i: F.get(F.col(f"{card}.sections"), i)["k"])


def _intervals(card: str, fit: str, start: Column) -> Column:
    """(k, first, last) of a card's kept sections in token positions from ``start`` on."""
    begin = F.struct((start + F.least(F.size(f"{card}.required"), F.col(f"{fit}.used"))).alias("at"), F.array().cast("array<struct<k:string,first:int,last:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        section = F.get(F.col(f"{card}.sections"), i)
        n = F.size(section["tokens"])
        one = F.struct(section["k"].alias("k"), s["at"].alias("first"), (s["at"] + n - 1).alias("last"))
        return F.struct((s["at"] + n).alias("at"), F.when(n > 0, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(f"{fit}.kept", begin, step, lambda s: s["out"])


def count_keys(keys: Column) -> Column:
    """A map of each key to how often it is there, in order of first use."""

    def counted(keys: Column) -> Column:
        own = F.array_distinct(keys)
        return F.map_from_arrays(own, F.transform(own, lambda k: F.size(F.filter(keys, lambda x: x == k))))

    return let(keys, counted)


def encode_pairs(rows: DataFrame, max_length: int, left: str = "left", right: str = "right", layout: str = "bert", skip_oversized: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """rows with the packed pair: tokens (with the layout's special ones, or their ids in ``special``), token_types (0 to the
    first card's end mark, then 1), owners (intervals of token positions and the attribute they belong to; no other token
    has an owner), present and included (how many attributes of each name both cards have, and how many are in)."""
    before, between, after = LAYOUTS[layout]
    n = len(before) + len(between) + len(after)
    marks = lambda names: F.array(*[F.lit(x if special is None else special[x]) for x in names])
    packed = pack_pairs(rows, max_length - n, left, right, skip_oversized)
    start = F.lit(len(before))
    second = start + F.col("left_fit.used") + len(between)
    tokens = F.concat(marks(before), fitted_tokens(left, "left_fit"), marks(between), fitted_tokens(right, "right_fit"), marks(after))
    ends = F.col("left_fit.used") + len(before) + 1
    keys = lambda card: F.transform(f"{card}.sections", lambda s: s["k"])
    return packed.select(
        *rows.columns, tokens.alias("tokens"), F.concat(F.array_repeat(F.lit(0), ends), F.array_repeat(F.lit(1), F.col("left_fit.used") + F.col("right_fit.used") + n - ends)).alias("token_types"),
        F.concat(_intervals(left, "left_fit", start), _intervals(right, "right_fit", second)).alias("owners"),
        count_keys(F.concat(keys(left), keys(right))).alias("present"), count_keys(F.concat(_fitted_keys(left, "left_fit"), _fitted_keys(right, "right_fit"))).alias("included"),
    )


def owner_of_tokens(tokens: Column, owners: Column) -> Column:
    """The owner of each token, null where it has none."""
    of = lambda owners: F.transform(tokens, lambda _, i: F.get(F.filter(owners, lambda o: (o["first"] <= i) & (i <= o["last"])), F.lit(0))["k"])
    return let(owners, of)


def attribute_coverage(rows: DataFrame, budget: int, left: str = "left", right: str = "right", skip_oversized: bool = False) -> DataFrame:
    """key, present, included, tokens over all packed pairs: how many attributes of a name there are, how many the budget lets
    in, and the tokens that they own. shape()s of cards do, and are cheaper."""
    # pairs of equal cards are packed once, which is few pairs where cards are shapes
    alike = rows.groupBy(F.col(left).alias(left), F.col(right).alias(right)).agg(F.count("*").alias("_pairs"))
    packed = pack_pairs(alike, budget, left, right, skip_oversized)
    # kept is bound before the lambda, or the packing would be computed again for each section
    of = lambda card, kept: F.transform(f"{card}.sections", lambda s, i: F.struct(s["k"].alias("key"), F.array_contains(kept, i).alias("kept"), F.size(s["tokens"]).alias("n")))
    side = lambda card, fit: let(F.col(f"{fit}.kept"), lambda kept: of(card, kept))
    every = F.concat(side(left, "left_fit"), side(right, "right_fit"))
    # of an inner explode Spark infers a filter and pushes it below, where it would compute the packing many times over
    each = packed.select("_pairs", F.explode_outer(every).alias("s")).filter("s IS NOT NULL").select("_pairs", "s.*")
    inside = lambda n: F.sum(F.when(F.col("kept"), n * F.col("_pairs")).otherwise(0)).cast("long")
    return each.groupBy("key").agg(F.sum("_pairs").alias("present"), inside(F.lit(1)).alias("included"), inside(F.col("n")).alias("tokens"))


def inferred_length(lengths: DataFrame, length: str, order: str, quantile: float = 0.95, sample: int = 10_000, cap: int = 512) -> DataFrame:
    """One row: the quantile ("higher") of the lengths, rounded up to a multiple of 8, between 8 and ``cap``. Of more than
    ``sample`` rows those are taken that stand at even distances in ``order``."""
    from ..operators.numbering import with_row_number

    if not 0 < quantile <= 1 or sample < 1 or cap < 8:
        raise ValueError("quantile in (0, 1], a positive sample and a cap of 8 at least")
    n = lengths.count()
    if n == 0:
        raise ValueError("no pairs")
    if n > sample:
        numbered = with_row_number(lengths.select(F.col(order).alias("o"), F.col(length).alias("length")), "r", "o")
        taken = numbered.filter(_evenly("r", n, sample))
        n = sample
    else:
        taken = lengths.select(F.col(length).alias("length"))
    # a row for each length; the rank of the quantile is ceil(quantile * (n - 1)), from 0
    counts = taken.groupBy("length").count()
    rank = -int(-(quantile * (n - 1)) // 1)
    below = F.sum("count").over(_ascending())
    picked = counts.withColumn("below", below).filter(F.col("below") > rank).agg(F.min("length").alias("length"))
    return picked.select(F.least(F.greatest(F.lit(8), (F.ceil(F.col("length") / 8) * 8)), F.lit(cap)).cast("long").alias("max_length"))


def _evenly(r: str, n: int, sample: int) -> Column:
    """Whether row r of n (from 0) is one of floor(k * (n - 1) / (sample - 1)), k from 0 to sample - 1: the least k that
    reaches r does not go past it."""
    if sample == 1:
        return F.col(r) == 0
    k = f"(CAST({r} AS DECIMAL(20,0)) * {sample - 1} + {n - 2}) DIV {n - 1}"
    return F.expr(f"(CAST({k} AS DECIMAL(20,0)) * {n - 1}) DIV {sample - 1}") == F.col(r)


def _ascending():
    from pyspark.sql import Window

    return Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)  # a row a length, no more than there are lengths

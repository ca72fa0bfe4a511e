"""Document fingerprints from closed syncmers (operator 10), in Spark's own functions only.

A k-mer is K characters in a row; it is an anchor if the least hash among its substrings of S characters is that of its
first or last. That depends on the k-mer alone, so a passage has the same anchors wherever it stands, and two anchors
that follow each other are at most K - S characters apart. The fingerprint is all anchors with their positions. Texts are
matched by links: two anchors that follow each other, at their distance. A link is found in another text only where the
same two anchors are as far apart, wherever that is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

K, S = 24, 3
#: An anchor is a long: the k-mer's hash (32 bits) above its position in characters (POSITION bits).
POSITION = 31
#: Ranges of doc_id for each task.
RANGES = 4


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a column put into a lambda is computed again at each step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all(conditions: list[Column]) -> Column:
    """Their conjunction, nested so that the first that fails ends it."""
    return reduce(lambda rest, c: c & rest, reversed(conditions))


def _anchor(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 32), POSITION).bitwiseOR(position.cast("long"))


def position(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << POSITION) - 1))


def kmer_hash(anchor: Column) -> Column:
    """32 bits, as a long."""
    return F.shiftrightunsigned(anchor, POSITION)


def anchors(text: Column) -> Column:
    """All anchors of a text in order of position, array<long>; see position() and kmer_hash().

    A text of fewer than K characters is one anchor at 0; null or empty: none. Ties for the least hash count as edges.
    """
    text = F.coalesce(text, F.lit(""))
    far = K - S

    def inner(c: Column) -> Column:
        hashed = F.transform(c, lambda x, i: F.xxhash64(x, *[F.get(c, i + j) for j in range(1, S)]))
        return F.slice(hashed, F.lit(1), F.size(c) - (S - 1))

    def closed(m: Column) -> Column:
        def anchor(x: Column, i: Column) -> Column:
            first = _all([x <= F.get(m, i + j) for j in range(1, far)])
            last = _all([F.get(m, i + far) <= F.get(m, i + j) for j in range(far - 1, 0, -1)])
            found = _anchor(F.xxhash64(*[F.get(m, i + j) for j in range(0, far + 1, S)]), i)
            return F.when(first | last, F.when(F.get(m, i + far).isNotNull(), found))  # only where a whole k-mer is left

        return F.filter(F.transform(m, anchor), lambda a: a.isNotNull())

    short = F.array(_anchor(F.xxhash64(text), F.lit(0)))
    n = F.char_length(text)
    return F.when(n >= K, _let(_let(F.split(text, ""), inner), closed)).when(n > 0, short).otherwise(F.array().cast("array<long>"))


def joined(left: Column, left_anchors: Column, right: Column, right_anchors: Column) -> Column:
    """The anchors of concat(left, right) from those of the texts that left and right are the start of: what lies whole
    in either, and the k-mers across, which are at most K - 1. Texts of fewer than K characters are hashed anew."""
    none = F.array().cast("array<long>")

    def parts(n: Column) -> Column:
        start = F.greatest(n - (K - 1), F.lit(0))
        across = F.concat(F.substring(left, start + 1, n - start), F.substring(right, F.lit(1), F.lit(K - 1)))
        moved = lambda a, by: F.transform(a, lambda x: x + by)
        over = F.when(F.char_length(across) >= K, _let(start.cast("long"), lambda by: moved(anchors(across), by))).otherwise(none)
        first = F.filter(left_anchors, lambda x: position(x) <= n - K)
        rest = _let(F.char_length(right), lambda m: F.filter(right_anchors, lambda x: position(x) <= m - K))
        return F.concat(first, over, _let(n.cast("long"), lambda by: moved(rest, by)))

    whole = F.concat(left, right)
    return F.when(F.char_length(whole) < K, anchors(whole)).otherwise(_let(F.char_length(left), parts))


def links(anchors: Column) -> Column:
    """The distinct links of a text: a hash of each anchor, the one before, and the distance between them."""
    link = lambda x, before: F.xxhash64(kmer_hash(x), kmer_hash(before), position(x) - position(before))
    return _let(anchors, lambda a: F.array_distinct(F.transform(a, lambda x, k: link(x, F.get(a, k - 1)))))


def fingerprint(anchors: Column) -> Column:
    """Eleven hex digits an anchor: 1, its hash (8), how many characters it is from the one before (from the start: the first)."""
    digits = lambda x, before: F.hex(F.shiftleft(kmer_hash(x), 8) + position(x) - F.coalesce(position(before), F.lit(0)) + F.lit(1 << 40))
    return _let(anchors, lambda a: F.lower(F.array_join(F.transform(a, lambda x, k: digits(x, F.get(a, k - 1))), "")))


def likeness(a: Column, b: Column) -> Column:
    """Share of common links (Jaccard) of two texts' links, 0 to 1; two empty ones are alike."""
    share = lambda a, b, n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n))
    return _let(b, lambda b: _let(F.size(F.array_intersect(a, b)), lambda n: share(a, b, n)))


def _cuts(quantiles: list[int]) -> list[tuple[int, int]]:
    """Cuts of (key, tie): a key that is several quantiles is cut within, by its rows' ties."""
    out = []
    for key, often in sorted(Counter(quantiles).items()):
        ties = [(1 << 63) - 1] if often == 1 else [(j << 64) // (often + 1) - (1 << 63) for j in range(1, often + 1)]
        out += [(key, tie) for tie in ties]
    return out


def _bucket(cuts: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the ascending cuts are less than (key, tie), by binary search."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    keys, ties = (F.lit([c[i] for c in cuts]) if cuts else F.array().cast("array<long>") for i in (0, 1))

    def less(i: Column) -> Column:
        return (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(ties, i) < tie))

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & less(lo + s - 1), lo + s).otherwise(lo))


def with_next(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text (null: empty), the columns of ``extra`` (of text and those before), and next_<col> of the next row in ascending
    doc_id order.

    Order: null doc_ids last (and with them 2 ** 63 - 1), ties by the text's hash, repeated rows one after another;
    after the last comes the first. Ranges of (doc_id, hash), bounded by approximate quantiles, are sorted each in a
    task; many texts of one doc_id, or of none, are several ranges, but repeats of one row are one. The first row of
    each range goes to the range before it as well. Texts are shuffled once, and ``extra`` is computed after that.
    """
    n = partitions(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    shares = [i / (RANGES * n) for i in range(1, RANGES * n)] or [0.5]
    cuts = _cuts(rows.select(F.percentile_approx("key", shares, 100 * RANGES * n).alias("b")).first()["b"] or [])
    placed = rows.withColumn("bucket", _bucket(cuts, F.col("key"), F.col("tie")))
    w = Window.orderBy("bucket")  # one row a range
    least = placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("least"))
    last = F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = least.select("least.*", F.coalesce(F.lag("bucket").over(w), last).alias("to"))
    firsts = rows.join(F.broadcast(before), ["key", "tie"]).dropDuplicates(["to"]).select(*rows.columns, F.col("to").alias("bucket"))
    both = placed.withColumn("guest", F.lit(0)).unionByName(firsts.withColumn("guest", F.lit(1)))
    dealt = both.repartitionByRange(n, "bucket")
    for name, column in (extra or {}).items():
        dealt = dealt.withColumn(name, column)
    inside = Window.partitionBy("bucket").orderBy("guest", "key", "tie")
    carried = ["text", *(extra or {})]
    out = dealt.select("doc_id", *carried, "guest", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried])
    return out.filter("guest = 0").drop("guest")


def edited(docs: DataFrame) -> DataFrame:
    """Each document and its edited text (the last half of its code points replaced by the first as many of the next
    document): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are over whole texts, however long; each text is hashed once, and an edited text's anchors are put
    together from those of its parts. Null texts count as empty, with an empty fingerprint; two empty ones have
    likeness 1. Equal texts have equal fingerprints. See with_next() for the order with null or repeated doc_ids. An
    empty table gives no rows; other columns are not read.
    """
    found = anchors(F.col("text"))
    rows = with_next(docs, {"anchors": found, "links": links(F.col("anchors"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n, "kept": F.substring("text", F.lit(1), n - half), "taken": F.substring("next_text", F.lit(1), half)})
    rows = rows.withColumn("changed", joined(F.col("kept"), F.col("anchors"), F.col("taken"), F.col("next_anchors")))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.concat("kept", "taken"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("links"), links(F.col("changed"))).alias("near_edited"), likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )

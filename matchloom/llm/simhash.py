"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard
from .common import fresh_path, materialize, partitions

BITS = 64
RADIUS = 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text: a bit is 1 if it is set in over half of the XXH64 (seed 42) of the
    ``width``-word shingles, repeats included. A shorter text is one shingle; no words (or null) give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = memoryview(b" ".join(words))
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounds the memory of very long texts
        block = h[i : i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(flips: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.lit(_signed(sum(1 << b for b in f))).cast("long") for f in flips])


def _spread(fps: DataFrame) -> DataFrame:
    """Rows of some bytes each are about to become thousands: over all tasks first, in as many as shuffles have."""
    return fps.repartition(partitions(fps.sparkSession), "fp")


def _suspects(fps: DataFrame, blocks: int = 3, near: int = 3) -> DataFrame:
    """The fingerprints that may have another within RADIUS: a superset, cheap to find.

    Some block of bits holds at least one of up to three differing bits. With that block masked out at most two differ,
    so the balls of half that radius (all variants within one flipped bit) meet: both emit a common variant. Those that
    share a variant with up to ``near`` others on either side are compared with them; in larger groups all stay.
    """

    def variants(masked: Column, flips: list) -> Column:
        return F.transform(_masks(flips), lambda m: masked.bitwiseXOR(m))

    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for lo, hi in zip(edges, edges[1:]):
        keep = _signed(((1 << BITS) - 1) ^ sum(1 << b for b in range(lo, hi)))
        tag = (lo + 1) % BITS  # a bit of the masked block sets the blocks' variants apart
        flips = [(), *[(b,) for b in range(BITS) if not lo <= b < hi]]
        masked = F.col("fp").bitwiseAND(F.lit(keep).cast("long")).bitwiseXOR(F.lit(_signed(1 << tag)).cast("long"))
        keys.append(variants(masked, flips))
    w = Window.partitionBy("variant").orderBy("fp")
    rows = _spread(fps).select("fp", F.explode(F.concat(*keys)).alias("variant"))
    # a group of over 2 * near members has, for each of them, one more than ``near`` places off; smaller ones don't need it
    beyond = [F.lag("fp", near + 1).over(w).isNotNull(), F.lead("fp", near + 1).over(w).isNotNull()]
    close = [F.bit_count(F.col("fp").bitwiseXOR(f("fp", k).over(w))) <= RADIUS for k in range(1, near + 1) for f in (F.lag, F.lead)]
    found = rows.select("fp", F.array(*beyond, *close).alias("signs"))
    return found.filter(F.array_contains("signs", True)).select("fp").distinct()


def _links(suspects: DataFrame) -> DataFrame:
    """(a, b), each a true link: bits differ in at most RADIUS places; their components are those of all such pairs.

    Every fingerprint emits all variants with one flipped bit at most, those of odd parity also variants with two
    flipped bits. Where a variant has a member of the inner ball, all others are within RADIUS of it (1 + 1 or 2 + 1),
    so links to that one member stand for all pairs. Pairs at distance 3 have different parity, and of their three
    bits two are in the same half of the 64, so pairs of bits within a half suffice. At most 2081
    fingerprints share a variant, however large a group of near copies is.
    """
    inner = [(), *[(b,) for b in range(BITS)]]
    outer = [p for half in (range(BITS // 2), range(BITS // 2, BITS)) for p in combinations(half, 2)]
    odd = F.bit_count("fp") % 2 == 1

    def ball(flips: list, far: int, of: DataFrame) -> DataFrame:
        return of.select("fp", F.lit(far).cast("byte").alias("far"), F.explode(F.transform(_masks(flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))

    suspects = _spread(suspects)
    rows = ball(inner, 0, suspects).unionByName(ball(outer, 1, suspects.filter(odd)))
    w = Window.partitionBy("variant").orderBy("far", "fp")
    hub = rows.select("fp", F.first("fp").over(w).alias("hub"), F.first("far").over(w).alias("hub_far"))
    found = hub.filter((F.col("hub_far") == 0) & (F.col("hub") != F.col("fp")))
    verified = found.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)
    return verified.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root): root is the least node of the component. edges: (a, b) of an orderable type, a > b.

    Alternates large-star and small-star steps until the edges no longer change; each step is a Spark job whose result
    is written to the shared folder. Only two numbers a step come to the driver.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    spark = edges.sparkSession
    path = fresh_path(spark, tag)
    edges = materialize(edges.select("a", "b").filter("a <> b"), tag, path)
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))  # and a join, which a hub with many edges can be split in
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        spent, path = path, fresh_path(spark, tag)
        edges = materialize(small, tag, path)
        discard(spark, spent)  # nothing reads the round before any more
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, fp (signed), text_hash, component_id.

    component_id is the smallest doc_id in the document's component of the graph that links fingerprints with at most
    RADIUS differing bits (texts without words have fingerprint zero and link alike). Null texts count as empty; a null
    doc_id is never the smallest unless the component has no other (then component_id is null). Repeated rows stay.
    """
    rows = materialize(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), simhash_udf(F.coalesce("text", F.lit(""))).alias("fp")), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(_links(materialize(_suspects(fps.select("fp")), "suspects")), "simhash-cc")
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(ids, rows.fp == ids._fp, "left").drop("_fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps one row of each component: that of the smallest doc_id (null last, then the least text hash).

    All columns stay, whatever their names. Of rows with equal doc_id and text one is kept. Null texts count as empty
    and are near each other and texts without words; texts are read whole, however long; an empty table gives no rows.
    """
    found = near_duplicate_components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"))
    keep = found.groupBy("root").agg(first.alias("k")).select("k.*")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(row, docs["doc_id"].isNull().alias("no_id"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), text_hash.alias("text_hash"))
    key = ["no_id", "id", "text_hash"]
    return keyed.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")

"""The pair graph: groups, components, triangles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical
from ..sources.shared import write_shared


def pair_groups(matches: DataFrame) -> DataFrame:
    """Adds group_id: the same for both ways round of a pair (a hash of the canonical pair; ids are arbitrary)."""
    return canonical(matches).withColumn("group_id", F.xxhash64("u", "v"))


def connected_components(edges: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """node, component (the least node reachable). Large-star and small-star rounds until nothing changes; each round
    is written to the shared folder, so a lost executor costs no more than its round."""
    spark, tag = edges.sparkSession, f"components-{uuid.uuid4().hex}"
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    state, n = None, 0
    while True:
        pairs = write_shared(pairs, f"{tag}-{n}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, n + 1
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        down = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        pairs = down.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
    return nodes.join(pairs, nodes.node == pairs.a, "left").select("node", F.coalesce("b", "node").alias("component"))


def stable_edges(matches: DataFrame) -> DataFrame:
    """A row for each canonical pair: u, v, target, confidence (mean over its rows), conflict (its rows' targets differ)."""
    confidence = F.avg("confidence") if "confidence" in matches.columns else F.lit(1.0)
    return canonical(matches).groupBy("u", "v").agg(F.min("target").alias("target"), confidence.alias("confidence"), (F.min("target") != F.max("target")).alias("conflict"))


#: Nodes of more edges are hubs, which come last in the order by which edges are turned; longer lists of marks are not kept.
HUB = 256


def _mark(node: Column) -> Column:
    """16 bits of a node's hash."""
    return F.shiftright(F.xxhash64(node), 48).cast("short")


def oriented(edges: DataFrame) -> DataFrame:
    """a, b, hb, t, c: each edge (u, v, target, confidence) turned from its end that comes first to the other: hubs come last, by
    degree (hb is that of b, 0 for other nodes), the rest by id. Other nodes have at most HUB edges out, hubs about
    sqrt(2 * edges). Hubs are few, and written, so that Spark sees it."""
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    hubs = write_shared(degree.filter(F.col("d") > HUB))
    of = lambda c: hubs.select(F.col("node").alias(c), F.col("d").alias(f"_{c}"))
    ranked = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").withColumns({"_u": F.coalesce("_u", F.lit(0)), "_v": F.coalesce("_v", F.lit(0))})
    forward = (F.col("_u") < F.col("_v")) | ((F.col("_u") == F.col("_v")) & (F.col("u") < F.col("v")))
    turned = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    return ranked.select(turned("u", "v").alias("a"), turned("v", "u").alias("b"), turned("_v", "_u").alias("hb"), F.col("target").alias("t"), F.col("confidence").alias("c"))


def wedges(out: DataFrame) -> DataFrame:
    """a, x, tx, cx, y, ty, cy: two edges out of one node, x before y, that an edge from x to y may close.

    Most pairs of edges are not closed and need not be shuffled to find that out: an edge to x brings the marks of the nodes
    that x has edges to, and a pair whose y has none of them is left out. All that are closed stay, others with the chance of
    equal marks; nodes of over HUB edges out have no list, and their pairs all stay.
    """
    marks = out.groupBy("a").agg(F.count("*").alias("n"), F.collect_list(_mark(F.col("b"))).alias("m")).select(F.col("a").alias("b"), F.when(F.col("n") <= HUB, F.col("m")).alias("m"))
    x = out.join(marks, "b").select("a", F.col("b").alias("x"), F.col("hb").alias("hx"), F.col("t").alias("tx"), F.col("c").alias("cx"), "m")
    y = out.select("a", F.col("b").alias("y"), F.col("hb").alias("hy"), F.col("t").alias("ty"), F.col("c").alias("cy"))
    before = (F.col("hx") < F.col("hy")) | ((F.col("hx") == F.col("hy")) & (F.col("x") < F.col("y")))
    return x.join(y, "a").filter(before & (F.col("m").isNull() | F.array_contains("m", _mark(F.col("y"))))).select("a", "x", "tx", "cx", "y", "ty", "cy")


def triangle_counts(edges: DataFrame, weighted: bool) -> DataFrame:
    """u, v, comparable, violations, weighted: over the common neighbours of each edge.

    edges: u < v, target, confidence. Edges are turned by oriented(), and two edges out of one node meet the third. A triangle
    counts for each of its three edges.
    """
    out = oriented(edges)
    third = out.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("t").alias("t3"), F.col("c").alias("c3"))
    triangles = wedges(out).join(third, ["x", "y"])

    def side(p: str, q: str, t: str, c: str, t1: str, c1: str, t2: str, c2: str):
        return F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.col(t).alias("t"), F.col(c).alias("c"), F.col(t1).alias("t1"), F.col(c1).alias("c1"), F.col(t2).alias("t2"), F.col(c2).alias("c2"))

    sides = F.array(side("a", "x", "tx", "cx", "ty", "cy", "t3", "c3"), side("a", "y", "ty", "cy", "tx", "cx", "t3", "c3"), side("x", "y", "t3", "c3", "tx", "cx", "ty", "cy"))
    each = triangles.select(F.explode(sides).alias("e")).select("e.*")
    wrong = F.when(F.col("t") == 1, F.col("t1") != F.col("t2")).otherwise((F.col("t1") == 1) & (F.col("t2") == 1))
    evidence = F.least("c1", "c2")
    weight = 2 * evidence / F.greatest(F.col("c") + evidence, F.lit(1e-12)) if weighted else F.lit(1.0)
    return each.groupBy("u", "v").agg(F.count("*").alias("comparable"), F.count_if(wrong).alias("violations"), F.sum(F.when(wrong, weight).otherwise(0.0)).alias("weighted"))


def transitivity_weights(matches: DataFrame, strength: float = 1.0, floor: float = 0.1, min_comparable: int = 1, weighted: bool = False) -> DataFrame:
    """Adds the columns of pair_transitivity() to each row of matches."""
    return canonical(matches).join(pair_transitivity(matches, strength, floor, min_comparable, weighted), ["u", "v"]).drop("u", "v")


def pair_transitivity(matches: DataFrame, strength: float = 1.0, floor: float = 0.1, min_comparable: int = 1, weighted: bool = False) -> DataFrame:
    """A row for each canonical pair (u, v): transitivity_comparable_neighbors, transitivity_violations,
    transitivity_violation_rate, weight_multiplier.

    Rows whose pair has both labels, and negative pairs of an item with itself, are contradictions: 1, 1, 1.0,
    max(floor, exp(-strength)). Else an edge is held against each common neighbour: a positive edge is violated where
    the neighbour's labels differ, a negative one where both are positive. With enough comparable neighbours the
    multiplier is max(floor, exp(-strength * rate)).
    """
    edges = write_shared(stable_edges(matches))  # read by each step below
    counts = triangle_counts(edges.filter("not conflict and u < v").select("u", "v", "target", "confidence"), weighted)
    direct = F.col("conflict") | ((F.col("u") == F.col("v")) & (F.col("target") == 0))
    rate = F.coalesce(F.col("weighted") / F.col("comparable"), F.lit(0.0))
    enough = (F.coalesce("comparable", F.lit(0)) >= min_comparable) & (F.coalesce("violations", F.lit(0)) > 0)
    penalty = lambda r: F.greatest(F.lit(floor), F.exp(-strength * r))
    return edges.join(counts, ["u", "v"], "left").select(
        "u", "v",
        F.when(direct, 1).otherwise(F.coalesce("comparable", F.lit(0))).cast("long").alias("transitivity_comparable_neighbors"),
        F.when(direct, 1).otherwise(F.coalesce("violations", F.lit(0))).cast("long").alias("transitivity_violations"),
        F.when(direct, 1.0).otherwise(rate).alias("transitivity_violation_rate"),
        F.when(direct, penalty(F.lit(1.0))).when(enough, penalty(rate)).otherwise(1.0).alias("weight_multiplier"),
    )


def constant_weights(matches: DataFrame) -> DataFrame:
    return matches.withColumn("weight_multiplier", F.lit(1.0))


def runs(rows: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal value: partition, run (0, 1, ...), value, first and last position, length (gaps and islands)."""
    w = Window.partitionBy(partition).orderBy(*order)
    numbered = rows.withColumns({"pos": F.row_number().over(w) - 1, "new": (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")})
    placed = numbered.withColumn("run", F.sum("new").over(Window.partitionBy(partition).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return placed.groupBy(partition, "run", value).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("length"))

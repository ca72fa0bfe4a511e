"""Array and vector functions for embeddings, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def mean_vector(vectors: Column, dimensions: int) -> Column:
    """Elementwise mean of an array of vectors; zeros for none."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(vectors), F.lit(1)))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def max_products(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Elementwise greatest product of a value in [low1, high1] and one in [low2, high2]."""
    corner = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    best = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    return best(best(corner(low1, low2), corner(low1, high2)), best(corner(high1, low2), corner(high1, high2)))


def masked_mean(vectors: Column, mask: Column, dimensions: int) -> Column:
    """Elementwise mean of the vectors whose mask is true (or not 0); zeros for none."""
    return mean_vector(_unmasked(vectors, mask), dimensions)


def masked_max(vectors: Column, mask: Column, dimensions: int) -> Column:
    """Elementwise greatest of the vectors whose mask is true (or not 0); zeros for none."""
    least = F.array_repeat(F.lit(float("-inf")), dimensions)
    best = F.aggregate(_unmasked(vectors, mask), least, lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y.cast("double"))))
    return F.transform(best, lambda x: F.when(x == float("-inf"), 0.0).otherwise(x))


def _unmasked(vectors: Column, mask: Column) -> Column:
    return F.filter(vectors, lambda _, i: F.get(mask, i).cast("boolean"))


def min_max_pool(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, low, high: elementwise least and greatest over the vectors of a key, by position and partial aggregation."""
    parts = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("p"))
    return rows.select(key, F.col("p.lo").alias("low"), F.col("p.hi").alias("high"))

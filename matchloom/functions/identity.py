"""Identity of rows and pairs: canonical pairs, portable seeded keys, required columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_48 = float(1 << 48)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that lists what is missing (sorted)."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def canonical(df: DataFrame, left: str = "id1", right: str = "id2") -> DataFrame:
    """Adds u and v, the smaller and the larger id: pairs are undirected."""
    return df.withColumns({"u": F.least(left, right), "v": F.greatest(left, right)})


def seeded_key(seed: int, *parts: str | Column) -> Column:
    """48 bits of the md5 of ``seed|part|part`` as a long: the same integer in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A seeded key as a number in (0, 1]."""
    return (key.cast("double") + 1) / TWO_48

"""Encoders and extractors of texts that plug in as Python objects: loaded once a worker, run over Arrow batches, in smaller
batches where they run out of memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let


class Encoder(Protocol):
    """Gives a result for each text, in order: an encoder a vector, an extractor a list of entities."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Any]: ...


ENTITY = T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


class Batches:
    """Runs an encoder over texts, ``size`` at a time. A batch that raises one of ``too_large`` is halved, down to one text,
    and so are those after it: the size that went is kept for the worker's other batches."""

    def __init__(self, encoder: Encoder, size: int, too_large: tuple[type[BaseException], ...] = (MemoryError,), clear: Callable[[], None] | None = None):
        if size < 1:
            raise ValueError("a batch has one text at least")
        self.encoder, self.size, self.too_large, self.clear = encoder, size, too_large, clear

    def __call__(self, texts: Sequence[str]) -> list:
        out: list = []
        while len(out) < len(texts):
            some = texts[len(out) : len(out) + self.size]
            try:
                found = self.encoder(some)
            except self.too_large:
                if len(some) == 1:
                    raise
                self.size = max(1, len(some) // 2)
                if self.clear is not None:
                    self.clear()
                continue
            if len(found) != len(some):
                raise ValueError(f"{len(found)} results for {len(some)} texts")
            out.extend(found)
        return out


def _applied(text: Column, load: Callable[[], Encoder], kind: T.DataType, size: int, too_large: tuple[type[BaseException], ...], clear: Callable[[], None] | None, sound: Callable[[Any], Any]) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = None
        for texts in batches:
            there = texts.notna()
            if apply is None and there.any():
                apply = Batches(load(), size, too_large, clear)
            found = iter(apply(texts[there].tolist()) if there.any() else ())
            yield pd.Series([sound(next(found)) if x else None for x in there], dtype=object)

    return run(text)


def encoded(text: Column, load: Callable[[], Encoder], dimensions: int, size: int = 256, too_large: tuple[type[BaseException], ...] = (MemoryError,), clear: Callable[[], None] | None = None) -> Column:
    """array<float> of each text by the encoder that ``load`` gives once a task; null texts aren't encoded and stay null.
    A vector of another length is an error. ``clear`` frees memory before a smaller batch is tried."""

    def vector(x) -> list[float]:
        x = [float(v) for v in x]
        if len(x) != dimensions:
            raise ValueError(f"a vector of {len(x)} instead of {dimensions}")
        return x

    return _applied(text, load, T.ArrayType(T.FloatType()), size, too_large, clear, vector)


def extracted(text: Column, load: Callable[[], Encoder], size: int = 256, too_large: tuple[type[BaseException], ...] = (MemoryError,), clear: Callable[[], None] | None = None) -> Column:
    """array of entities (label, text, start, end, score) of each text, as ``encoded``. The extractor gives a list of dicts or
    tuples a text."""
    names = ENTITY.fieldNames()

    def rows(found) -> list[dict]:
        return [dict(e) if isinstance(e, dict) else dict(zip(names, e)) for e in found]

    return _applied(text, load, T.ArrayType(ENTITY), size, too_large, clear, rows)


def entities_as_attributes(entities: Column) -> Column:
    """Entities as attributes (k, v): label and text, of equal labels the first."""
    pairs = F.transform(entities, lambda e: F.struct(e["label"].alias("k"), e["text"].alias("v")))
    return let(pairs, lambda own: F.filter(own, lambda a, i: ~F.exists(F.slice(own, F.lit(1), i), lambda o: o["k"] == a["k"])))

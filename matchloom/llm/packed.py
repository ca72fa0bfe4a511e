"""Token-id files of fixed-width bit packing (operator 5).

A file holds blocks of BLOCK ids, each id in the fewest bits that hold the vocabulary, then a footer: the end of each
document in ids, its doc_id and whether it has one, the byte offset of each block, and a JSON trailer with its length.
Any run of ids is read from the blocks that hold it, unpacked by numpy.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, partitions
from .encoder import word_encoder
from .files import make_folder, opened, written

BLOCK = 1 << 14
MAGIC = b"PKID0001"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width < 32 and len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class Writer:
    """Appends documents to a stream; close() writes the footer."""

    def __init__(self, out, vocabulary: int):
        self.out, self.width = out, bits_for(vocabulary)
        self.ends: list[int] = []
        self.ids: list[int] = []
        self.known: list[bool] = []
        self.offsets: list[int] = []
        self.total = 0
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC)
        self.at = len(MAGIC)

    def _blocks(self, last: bool) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        whole = len(flat) if last else len(flat) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            raw = pack(flat[i : i + BLOCK][: whole - i], self.width)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.ends.append(self.total)
        self.known.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        for column, kind in ((self.ends, "<i8"), (self.ids, "<i8"), (self.known, "u1"), (self.offsets, "<i8")):
            self.out.write(np.array(column, kind).tobytes())
        trailer = json.dumps({"width": self.width, "block": BLOCK, "ids": self.total, "docs": len(self.ends), "blocks": len(self.offsets), "footer": self.at}).encode()
        self.out.write(trailer + len(trailer).to_bytes(8, "little"))


class Reader:
    """Random access: ids(start, stop) and document(i) of a packed file."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.about = json.loads(self.file.read_at(n, size - 8 - n))
        docs, blocks, at = self.about["docs"], self.about["blocks"], self.about["footer"]
        raw = self.file.read_at(docs * 17 + blocks * 8, at)
        self.ends = np.frombuffer(raw, "<i8", docs)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * docs)
        self.known = np.frombuffer(raw, "u1", docs, 16 * docs).astype(bool)
        self.offsets = np.append(np.frombuffer(raw, "<i8", blocks, 17 * docs), at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        block = self.about["block"]
        a, b = start // block, -(-stop // block)
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        # full blocks end on whole bytes (block is a multiple of 8), so neighbours unpack as one
        n = min(b * block, self.about["ids"]) - a * block
        return unpack(raw, n, self.about["width"])[start - a * block : stop - a * block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, uri: str | None = None) -> DataFrame:
    """Encodes every text (null: empty), adds end_id and writes packed files in ascending doc_id order.

    Returns the manifest: shard, uri, docs, tokens; ids of shard k come before those of shard k + 1. Null doc_ids come
    last, ties are broken by the text's hash; repeated rows are written each. Texts are encoded whole, however long. An
    id beyond the vocabulary's bits is an error. Other columns are not read. An empty table writes no file.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "packed")
    make_folder(uri)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard = word_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        first = next(batches, None)
        if first is None:
            return
        name = f"{uri}/shard-{shard:06d}.pkid"
        with written(name) as out:
            w = Writer(out, vocabulary)
            pdf = first
            while pdf is not None:
                encoded = encoder.encode(pdf["text"].tolist())
                for i, known, ids in zip(pdf["doc_id"], pdf["known"], encoded):
                    w.add(int(i) if known else None, np.frombuffer(ids + end, "<u4"))
                pdf = next(batches, None)
            w.close()
        yield pd.DataFrame({"shard": [shard], "uri": [name], "docs": [len(w.ends)], "tokens": [w.total]})

    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(text)]
    rows = docs.select("doc_id", text.alias("text"))
    sorted_rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    filled = sorted_rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return materialize(filled.mapInPandas(write, "shard int, uri string, docs long, tokens long"), "packed-manifest")


def read_packed(manifest: DataFrame, window: int = 1 << 20) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of uint32, little-endian)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    shards = manifest.select("uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, base in zip(pdf["uri"], pdf["base"]):
                r = Reader(uri)
                starts = np.concatenate(([0], r.ends[:-1]))
                crc = np.zeros(len(starts), np.int64)
                held, at = np.zeros(0, "<u4"), 0
                for i, (a, b) in enumerate(zip(starts.tolist(), r.ends.tolist())):
                    c = 0
                    for lo in range(a, b, window):  # very long documents come in windows
                        hi = min(b, lo + window)
                        if hi > at + len(held):
                            held, at = r.ids(lo, min(lo + 2 * window, r.about["ids"])), lo
                        c = zlib.crc32(held[lo - at : hi - at].tobytes(), c)
                    crc[i] = c
                doc_id = pd.array(r.doc_ids, "Int64")
                doc_id[~r.known] = pd.NA
                yield pd.DataFrame({"doc_id": doc_id, "start": starts + base, "n_tokens": r.ends - starts, "ids_crc32": crc})

    return shards.repartition(partitions(manifest.sparkSession)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

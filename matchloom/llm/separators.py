"""Token counts by separator scan (operator 4): lengths of documents in flat token files that have no index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, partitions
from .encoder import word_encoder
from .files import make_folder, opened, written

#: Ids a block, the unit of work of the scan.
BLOCK = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, separator: int, uri: str | None = None, width: int = 2) -> DataFrame:
    """Encodes every text (null: empty) and writes flat files of ids of ``width`` bytes, little-endian, ``separator``
    after each document. A file has the rows of one partition, in their order; nothing is shuffled. An id that does not
    fit in ``width`` bytes is an error. Texts are encoded whole, however long.

    Returns file, i, doc_id: which document is the i-th of a file; and uri and bytes in the last row of each file.
    """
    uri = uri or fresh_path(docs.sparkSession, "flat")
    make_folder(uri)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, k = word_encoder(tokenizer), TaskContext.get().partitionId()
        end, size, n = np.array([separator], "<u4").tobytes(), 0, 0
        pdf = next(batches, None)
        if pdf is None:
            return
        name = f"{uri}/tokens-{k:06d}.bin"
        with written(name) as out:
            while pdf is not None:
                for ids in encoder.encode(pdf["text"].tolist()):
                    own = np.frombuffer(ids + end, "<u4")
                    if width < 4 and own.max() >> 8 * width:
                        raise ValueError(f"an id does not fit in {width} bytes")
                    raw = own.astype(f"<u{width}").tobytes()
                    out.write(raw)
                    size += len(raw)
                rows = pd.DataFrame({"file": k, "i": np.arange(n, n + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64").array, "uri": pd.Series([None] * len(pdf), dtype=object), "bytes": pd.array([pd.NA] * len(pdf), "Int64")})
                n += len(pdf)
                pdf = next(batches, None)
                if pdf is not None:
                    yield rows
        rows.loc[len(rows) - 1, ["uri", "bytes"]] = [name, size]
        yield rows

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(write, "file int, i long, doc_id long, uri string, bytes long"), "flat-rows")


def scan(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The documents in flat token files (columns file, uri, bytes): file, i (0, 1, ... in the file), start (position of
    its first id), n_tokens (without the separator).

    Each block is searched on its own by numpy. A document's start is the separator before it, which may be blocks
    back: a running maximum over the blocks' last separators (a row a block) stitches them, and a running sum of their
    separators numbers the documents. Ids after a file's last separator are a last document. Empty files have none.
    """
    blocks = files.filter("bytes > 0").select(
        "file", "uri", F.floor(F.col("bytes") / width).alias("ids"), F.explode(F.expr(f"sequence(0L, cast((bytes - 1) div {width * block} as long))")).alias("block")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, uri, ids, b in zip(pdf["file"], pdf["uri"], pdf["ids"], pdf["block"]):
                at = int(b) * block
                n = min(block, int(ids) - at)
                with opened(uri) as stream:
                    found = np.flatnonzero(np.frombuffer(stream.read_at(n * width, at * width), f"<u{width}") == separator) + at
                tail = at + n == ids and (not len(found) or found[-1] != ids - 1)
                ends = np.append(found, ids) if tail else found
                previous = np.concatenate(([-2], ends[:-1])) if len(ends) else ends
                yield pd.DataFrame({"file": [f], "block": [b], "previous": [previous], "ends": [ends], "last": [found[-1] if len(found) else -1]})

    found = materialize(blocks.repartition(partitions(files.sparkSession)).mapInPandas(search, "file int, block long, previous array<long>, ends array<long>, last long"), "separators")
    # a prefix scan over one row a block
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    light = found.select("file", "block", "last", F.size("ends").alias("n"))
    stitched = light.select("file", "block", F.coalesce(F.max("last").over(inside), F.lit(-1)).alias("carried"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("first"))
    rows = found.join(stitched, ["file", "block"]).select("file", "carried", "first", F.posexplode(F.arrays_zip("previous", "ends")).alias("k", "d"))
    previous = F.when(F.col("k") == 0, F.col("carried")).otherwise(F.col("d.previous"))
    return rows.select("file", (F.col("first") + F.col("k")).alias("i"), (previous + 1).alias("start"), (F.col("d.ends") - previous - 1).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, separator: int, width: int = 2) -> DataFrame:
    """doc_id, file, start, n_tokens of every document, counted in flat files written from docs.

    Null and empty texts have 0 tokens; null doc_ids and repeated rows are counted each; an empty table writes no file
    and gives no rows. Other columns are not read.
    """
    rows = write_flat(docs, tokenizer, separator, width=width)
    found = scan(rows.filter("bytes is not null").select("file", "uri", "bytes"), separator, width)
    return rows.select("file", "i", "doc_id").join(found, ["file", "i"]).select("doc_id", "file", "start", "n_tokens")

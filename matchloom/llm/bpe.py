"""Byte-level BPE encoding and decoding by DuckDB queries in each partition (operator 6).

Encoding: each pre-token's bytes are rows (word, position, id) that join the merge table; a recursive query contracts
each word's leftmost pair of least rank until none is left. Decoding: ids join the vocabulary, and an ordered
aggregation strings their bytes together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that are new or used again until a worker forgets those not used since it last forgot; pre-tokens a recursive
#: query takes at once; ids a decoding query takes at once.
REMEMBER, WORDS, IDS = 300_000, 32_000, 250_000
#: Characters of the texts that are encoded at once: by a codec that is kept, and by one that is to take little memory.
TEXT, LITTLE = 6_000_000, 500_000
#: Characters of a word that is remembered, at most.
REMEMBER_LENGTH = 64
#: A recursive query keeps a row for each id and step, so quadratic in a word. Pre-tokens over LONG bytes go to a query
#: that takes many steps as one and ends after some ROWS rows, to be started again from where it got to.
LONG, ROWS = 200, 2_000_000
#: MB that DuckDB may use in a worker, and bytes more for each byte of a longer pre-token.
MEMORY, MEMORY_A_BYTE = 300, 400
UNSAFE = re.compile(r" (?:\s|\Z)")

#: ``least`` packs the rank of the contraction that is due in a word, the position of its first id and how far its second id,
#: which goes, is from there (less than LONG, so 8 bits).
CONTRACT = """
WITH RECURSIVE step(word, pos, id, done) AS (
    SELECT word, pos, id, false FROM bytes
    UNION ALL
    SELECT word, pos, CASE WHEN pos = (least >> 8) & 4294967295 THEN (least >> 40)::INTEGER ELSE id END, least IS NULL
    FROM (SELECT word, pos, id FROM step WHERE NOT done)
    LEFT JOIN (
        SELECT word, min((m.id::BIGINT << 40) + (pos << 8) + next_pos - pos) AS least
        FROM (SELECT word, pos, id, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id, lead(word) OVER w AS next_word FROM step WHERE NOT done WINDOW w AS (ORDER BY pos)) s
        JOIN merges m ON m.first = s.id AND m.second = s.next_id
        WHERE next_word = word GROUP BY word
    ) USING (word)
    WHERE least IS NULL OR pos <> ((least >> 8) & 4294967295) + (least & 255)
)
SELECT word, list(id ORDER BY pos) AS ids FROM step WHERE done GROUP BY word ORDER BY word
"""

#: As CONTRACT, but a step contracts one pair of least rank after another, from the left, up to the first whose new id
#: has a pair of lower rank with a neighbour (``early``): until then the next contraction is that of the same pair. In a
#: run of equal ids every other pair is one. Ends after $steps steps.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, id, depth, done) AS (
    SELECT word, pos, id, 0, false FROM bytes
    UNION ALL
    SELECT word, pos, CASE WHEN taken THEN rank ELSE id END, depth + 1, rank IS NULL
    FROM (
        SELECT *, lag(taken) OVER (ORDER BY pos) AS contracted
        FROM (
            SELECT *, coalesce(chosen AND pos <= min(CASE WHEN early THEN pos ELSE 9223372036854775807 END) OVER (PARTITION BY word), false) AS taken
            FROM (
                SELECT c.*, chosen AND (coalesce(l.id < rank, false) OR coalesce(r.id < rank, false)) AS early
                FROM (
                    SELECT *, CASE WHEN lag(chosen, 2) OVER w THEN rank ELSE lag(id) OVER w END AS left_id, lag(word) OVER w AS left_word, lead(id, 2) OVER w AS right_id, lead(word, 2) OVER w AS right_word
                    FROM (SELECT *, hit AND (nth - coalesce(max(CASE WHEN NOT hit THEN nth END) OVER (ORDER BY pos), 0)) % 2 = 1 AS chosen
                          FROM (SELECT *, row_number() OVER (ORDER BY pos) AS nth, coalesce(pair = rank, false) AS hit
                                FROM (SELECT s.*, m.id AS pair, min(m.id) OVER (PARTITION BY s.word) AS rank
                                      FROM (SELECT word, pos, id, depth, lead(id) OVER w AS next_id, lead(word) OVER w AS next_word FROM step WHERE NOT done AND depth < $steps WINDOW w AS (ORDER BY pos)) s
                                      LEFT JOIN merges m ON m.first = s.id AND m.second = s.next_id AND s.next_word = s.word)))
                    WINDOW w AS (ORDER BY pos)
                ) c
                LEFT JOIN merges l ON chosen AND left_word = word AND l.first = left_id AND l.second = rank
                LEFT JOIN merges r ON chosen AND right_word = word AND r.first = rank AND r.second = right_id
            )
        )
    )
    WHERE contracted IS NOT TRUE
)
SELECT word, pos, id, done FROM step WHERE done OR depth = $steps ORDER BY pos
"""

DECODE = """
SELECT ids.doc, string_agg(v.piece, '' ORDER BY ids.pos) AS piece
FROM ids JOIN vocabulary v ON v.id = ids.id GROUP BY ids.doc ORDER BY ids.doc
"""


class Codec:
    def __init__(self, path: str, pattern: str, at_once: int = WORDS):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.pretokens = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        first, second, merged = map(np.array, zip(*pairs))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self.db.register("m", pa.table({"first": first.astype("i4"), "second": second.astype("i4"), "id": merged.astype("i4")}))
        self.db.execute("CREATE TABLE merges AS FROM m")
        # bytes as the characters of the same numbers, so that pieces that are no UTF-8 can be strung together
        self.db.register("v", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS FROM v")
        self.remember, self.at_once = REMEMBER, at_once
        self.spaced = pattern == public_tokenizers.PATTERN  # a pre-token starts at every space that text follows
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def close(self) -> None:
        """Gives back what the codec holds."""
        self.db.close()
        self.words, self.older, self.ranks = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def contract(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian uint32) of distinct pre-tokens."""
        out, short = {}, []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                out[w] = self._contract_long(raw)
            else:
                short.append((w, raw))
        for at in range(0, len(short), self.at_once):
            some = short[at : at + self.at_once]
            lengths = np.fromiter((len(raw) for _, raw in some), np.int64, len(some))
            flat = self.byte_ids[np.frombuffer(b"".join([raw for _, raw in some]), np.uint8)]
            word = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
            self.db.register("bytes", pa.table({"word": word, "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
            found = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("bytes")
            ids = found["ids"].combine_chunks()
            raw, ends = np.asarray(ids.flatten()).astype("<u4").tobytes(), (np.asarray(ids.offsets) * 4).tolist()
            for (w, _), a, b in zip(some, ends, ends[1:]):
                out[w] = raw[a:b]
        return out

    def _contract_long(self, raw: bytes) -> bytes:
        self.db.execute(f"SET memory_limit = '{MEMORY + MEMORY_A_BYTE * len(raw) // 1_000_000}MB'")
        flat = self.byte_ids[np.frombuffer(raw, np.uint8)]
        state = pa.table({"word": np.zeros(len(flat), np.int32), "pos": np.arange(len(flat), dtype=np.int64), "id": flat})
        while True:
            self.db.register("bytes", state)
            found = self.db.sql(CONTRACT_LONG, params={"steps": max(8, ROWS // len(state))}).to_arrow_table()
            self.db.unregister("bytes")
            if found["done"][0].as_py():
                return found["id"].to_numpy().astype("<u4").tobytes()
            state = found.drop_columns("done")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with its space: contracted once and remembered while they are used."""
        get, old = self.words.get, self.older.get
        found = [get(w) for w in words]
        whole, parts = [], {}
        for w, i in zip(words, found):
            if i is not None:
                continue
            spaced = self.spaced and w[:1] == " "
            if spaced and w[1:].isalpha():
                whole.append(w)
            elif spaced and w[-1] in ".," and w[1:-1].isalpha():  # " word," is " word" and ",", and is not remembered
                parts[w] = w[:-1], w[-1]
            else:
                parts[w] = self.pretokens(w)
        need = dict.fromkeys(whole)
        need.update((x, None) for p in parts.values() for x in p)
        new = {w: i for w in need if (i := get(w) or old(w)) is not None}
        new |= self.contract([w for w in need if w not in new])
        for w, p in parts.items():
            if len(p) != 1:
                new[w] = b"".join([new[x] for x in p])
        self.words.update((w, i) for w, i in new.items() if len(parts.get(w, ())) != 2 and len(w) <= REMEMBER_LENGTH)
        if len(self.words) > self.remember:
            self.words, self.older = {}, self.words
        return [i if i is not None else new[w] for w, i in zip(words, found)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and where each text's end."""
        # Where a pre-token starts at every space that text follows, texts fall apart there, but for texts with double or
        # trailing spaces.
        plain = [self.spaced and UNSAFE.search(t) is None for t in texts]
        cut = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
        spaced = cut.flatten().dictionary_encode()
        number, bounds = spaced.indices.to_numpy().astype(np.int64), np.asarray(cut.offsets)
        others: dict[str, int] = {}  # first words, which have no space before them, and pre-tokens of the other texts
        base, which, k = len(spaced.dictionary), [], 0
        for t, p in zip(texts, plain):
            if p:
                own = number[bounds[k] : bounds[k + 1]]
                own[0] = base + others.setdefault(t.partition(" ")[0], len(others))
                k += 1
            else:
                own = np.array([base + others.setdefault(w, len(others)) for w in self.pretokens(t)], np.int64)
            which.append(own)
        ids = self._words([f" {w}" for w in spaced.dictionary.to_pylist()] + list(others)) if texts else []
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        stored, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        every = np.concatenate([np.zeros(0, np.int64), *which])
        length = size[every]
        ends = np.cumsum(length)
        flat = stored[np.repeat(starts[every] - (ends - length), length) + np.arange(length.sum())]
        return flat, np.concatenate(([0], ends))[np.cumsum([len(w) for w in which], dtype=np.int64)] if texts else np.zeros(0, np.int64)

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        out = [b""] * len(ends)
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        for at in range(0, len(flat), IDS):
            part = slice(at, at + IDS)
            n = len(flat[part])
            self.db.register("ids", pa.table({"doc": doc[part], "pos": np.arange(n, dtype=np.int32), "id": flat[part].astype("i4")}))
            for d, piece in self.db.execute(DECODE).fetchall():
                out[d] += piece.encode("latin-1")
            self.db.unregister("ids")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker, file and pattern."""
    return Codec(path, pattern)


def _some(pdf: pd.DataFrame, characters: int) -> Iterator[pd.DataFrame]:
    ends = np.cumsum(pdf["text"].str.len().to_numpy()) // characters
    for _, part in pdf.groupby(ends, sort=False):
        yield part


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, keep: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Null texts count as empty (0 tokens, the digests of no bytes); repeated rows and null doc_ids stay. Each match of
    pattern is encoded on its own by the ranks in path, without special tokens, and the ids are decoded again. Texts are
    encoded whole, however long; of equal pairs of least rank the leftmost is contracted first. Other columns are not
    read; an empty table gives no rows. One pass over the rows: nothing is shuffled. A worker remembers 2 * REMEMBER
    words of REMEMBER_LENGTH characters at most; with ``keep`` it does so for its next tasks; else it takes fewer at once and its memory is
    free for other work when a task ends, at some CPU time.
    """
    fields = [("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern) if keep else Codec(path, pattern, WORDS // 2)
        for batch in batches:
            batch["text"] = batch["text"].where(batch["text"].notna(), "")
            for pdf in _some(batch, TEXT if keep else LITTLE):
                flat, ends = c.encode(pdf["text"].tolist())
                encoded = np.split(flat, ends[:-1])
                out = {
                    "doc_id": pdf["doc_id"].astype("Int64").array,
                    "n_tokens": np.diff(ends, prepend=0),
                    "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in c.decode(flat, ends)],
                }
                if ids:
                    out["ids"] = [e.view("<i4") for e in encoded]
                yield pd.DataFrame(out)
        if not keep:
            c.close()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(run, schema)

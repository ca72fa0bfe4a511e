"""Phrase collocations of each language (operator 11).

Words, and phrases of two to four words, are numbered by minimal perfect hashes over Apriori-safe candidates: a phrase is a
candidate if both phrases of one word less in it are frequent. Its key is their two slots, so comparing the key that is
stored in a slot tells for certain whether a phrase is the slot's. Tasks count slots with numpy.bincount, the arrays are
summed as a tree, and the frequencies of a phrase and of the parts of its cuts are read by slot.

A hash is kept in blocks of about BLOCK keys, files in the shared folder that tasks read one after another; counts are
taken in rounds of ROUND slots. What a task holds therefore doesn't grow with the corpus.
"""

from __future__ import annotations

import io
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, partitions, small_batches
from .files import make_folder, opened, written

LONGEST, FREQUENT, TOP, SCALE, COVERED = 4, 30, 2_000, 2_000_000, 80
#: A-Z in lower case; what ends a piece is one byte, which is no word's.
LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\r\x0b\x0c", bytes(range(97, 123)) + b"\n" * 9)
BREAK, PLAIN = b".", "und"
#: Keys of a block, blocks that a worker keeps at hand, positions of a hash for each key, slots of a counted array.
BLOCK, AT_HAND, ROOM, PIECE = 1 << 19, 24, 2, 1 << 16
#: Slots counted in one pass over the corpus; branches of the tree that sums arrays.
ROUND, BRANCHES = 1 << 23, 16
#: Words and phrases that a task holds before it passes them on; documents tokenised at once; word slots in a row.
HELD, AT_ONCE, ROW = 1 << 18, 256, 2_048
#: Keys of phrases that a task adds up before it passes them on.
HELD_KEYS = 1 << 19
#: Rows of a batch that a task passes on.
PASSED = 1 << 16
#: Word slots that a task looks up at once (a longer text's are one piece).
CHUNK = 1 << 18


def tokens(raw: bytes) -> list[bytes]:
    """The words of a text in order, BREAK between pieces."""
    return raw.translate(LOWER).replace(b"\n", b" . ").split()


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(30)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys (int64). Keys that are alone at their position of a level have their slot there, by
    the position's rank; the others go on to the next level. Each slot's key is stored (and a second one, if given), so a
    key that isn't there is told from those that are."""

    def __init__(self, sizes: np.ndarray, alone: np.ndarray, stored: np.ndarray):
        self.sizes, self.stored = sizes, stored
        self.slot = np.where(alone, np.cumsum(alone) - 1, -1).astype(np.int32)

    @classmethod
    def build(cls, keys: np.ndarray, second: np.ndarray | None = None) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys of a perfect hash must be distinct")
        sizes, alone, left = [], [], keys
        while len(left):
            size = ROOM * len(left) + 1
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            often = np.bincount(at, minlength=size)
            sizes.append(size)
            alone.append(often == 1)
            left = left[often[at] > 1]
        made = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *alone]), np.zeros((0, 1), np.int64))
        both = keys[:, None] if second is None else np.stack([keys, second], 1)
        made.stored = np.zeros_like(both)
        made.stored[made._ranks(keys)] = both
        return made

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            found = self.slot[start + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)]
            out[left] = found
            left = left[found < 0]
            start += size
            if not len(left):
                break
        return out

    def slots(self, keys: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key, -1 of those that aren't there."""
        out = self._ranks(keys)
        at = np.flatnonzero(out >= 0)
        right = self.stored[out[at], 0] == keys[at]
        if second is not None:
            right &= self.stored[out[at], 1] == second[at]
        out[at[~right]] = -1
        return out

    def save(self, uri: str) -> None:
        raw = io.BytesIO()
        np.savez(raw, sizes=self.sizes, alone=np.packbits(self.slot >= 0), room=len(self.slot), stored=self.stored)
        with written(uri) as out:
            out.write(raw.getvalue())

    @classmethod
    def load(cls, uri: str) -> PerfectHash:
        with opened(uri) as f, np.load(io.BytesIO(f.read())) as x:
            return cls(x["sizes"], np.unpackbits(x["alone"], count=int(x["room"])).astype(bool), x["stored"])


@lru_cache(maxsize=AT_HAND)
def _block(uri: str) -> PerfectHash:
    return PerfectHash.load(uri)


class Table:
    """The blocks of a hash: a key is in block key mod blocks, and its slot counts from the block's offset."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.offsets = [sum(sizes[:b]) for b in range(len(sizes))]

    def __len__(self) -> int:
        return sum(self.sizes)

    def slots(self, keys: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        which = keys % len(self.sizes)
        order = np.argsort(which, kind="stable") if len(self.sizes) > 1 else np.arange(len(keys))
        bounds = np.searchsorted(which[order], np.arange(len(self.sizes) + 1))
        for b, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            if lo < hi and self.sizes[b]:
                at = order[lo:hi]
                found = _block(f"{self.folder}/{b}").slots(keys[at], None if second is None else second[at])
                out[at] = np.where(found < 0, -1, found + self.offsets[b])
        return out


def build(keys: DataFrame, carried: list[str], second: str | None = None) -> tuple[Table, DataFrame] | None:
    """The hash of distinct keys (``key``), and slot, key and the carried columns of each. None without keys."""
    spark = keys.sparkSession
    n = keys.count()
    if n == 0:
        return None
    blocks, folder = math.ceil(n / BLOCK), fresh_path(spark, "phrases")
    make_folder(folder)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        own, more = pdf["key"].to_numpy(np.int64), None if second is None else pdf[second].to_numpy(np.int64)
        made = PerfectHash.build(own, more)
        made.save(f"{folder}/{int(pdf['block'][0])}")
        return pdf.assign(local=made.slots(own, more))

    dealt = keys.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", local long"
    found = materialize(dealt.groupBy("block").applyInPandas(run, kind), "phrase-slots")
    sizes = {r["block"]: r["n"] for r in found.groupBy("block").agg(F.count("*").alias("n")).collect()}
    table = Table(folder, [sizes.get(b, 0) for b in range(blocks)])
    offset = F.get(F.lit(table.offsets).cast("array<long>"), F.col("block"))
    return table, found.select((F.col("local") + offset).alias("slot"), "key", *carried)


def _word_keys(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of a language."""
    import xxhash

    own = lang.encode("utf-8", "surrogatepass")
    own = len(own).to_bytes(4, "little") + own
    raw = b"".join([xxhash.xxh3_128_digest(own + w) for w in words])
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language, AT_ONCE at most."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            own: dict[str, list[bytes]] = {}
            part = b.slice(at, AT_ONCE)
            for lang, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own.setdefault(lang, []).append(raw)
            yield from own.items()


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word (bytes), n of docs (lang, raw); tasks add up what they hold before they pass it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            while held:
                lang, own = held.popitem()
                pairs = iter(own.items())
                while some := list(itertools.islice(pairs, PASSED)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])

        for lang, raws in _documents(batches):
            own = held.setdefault(lang, Counter())
            for raw in raws:
                own.update(tokens(raw))
            own.pop(BREAK, None)
            if sum(map(len, held.values())) > HELD:
                yield from passed_on()
        yield from passed_on()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(docs: DataFrame, words: Table) -> DataFrame:
    """Rows of the slots of words in order, -1 for infrequent words and where pieces end. A row ends with -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(np.concatenate(held)))], ["slots"])

        for lang, raws in _documents(batches):
            if sum(map(len, known.values())) > HELD:
                known.clear()
            own = known.setdefault(lang, {BREAK: -1})
            split = [tokens(raw) for raw in raws]
            lacking = list(set().union(*split).difference(own))
            if lacking:
                own.update(zip(lacking, words.slots(*_word_keys(lang, lacking)).tolist()))
            for words_of in split:
                held += [np.fromiter(map(own.__getitem__, words_of), np.int32, len(words_of)), np.array([-1], np.int32)]
                size += len(words_of) + 1
                if size >= ROW:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return docs.mapInArrow(run, "slots array<int>")


def _longer(slots: np.ndarray, table: Table | None) -> np.ndarray:
    """From the slots of the phrases that start at each place those of the phrases one word longer; without a table, their keys."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    keys = slots[at] << 32 | slots[at + 1]
    if table is None:
        return keys
    out = np.full(max(0, len(slots) - 1), -1, np.int64)
    out[at] = table.slots(keys)
    return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The slots of neighbouring rows, CHUNK of them if a row isn't longer."""
    for b in batches:
        rows = b.column(0)
        ends = np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            yield rows.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = to


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[order][first], np.add.reduceat(n[order], first) if len(keys) else n


def candidates(rows: DataFrame, tables: list[Table]) -> DataFrame:
    """Keys of the phrases one word longer than those of the last of tables (phrases of 2, 3, ... words) that are there often
    enough and whose two parts of one word less are both frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), PASSED):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + PASSED]), pa.array(n[at : at + PASSED])], ["key", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for slots in _arrays(batches):
            keys = _longer(reduce(_longer, tables, slots), None)
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_KEYS:
                held = [_summed(held)]
                if len(held[0][0]) > HELD_KEYS / 2:
                    yield from made(*held.pop())
        if held:
            yield from made(*_summed(held))

    # dealt by key at once: the tasks have added up what they could, and Spark needn't hold it a second time
    dealt = rows.mapInArrow(run, "key long, n long").repartition(partitions(rows.sparkSession), "key")
    return dealt.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).select("key")


def _added(arrays: DataFrame, *keys: str) -> DataFrame:
    """The sum of the arrays (counts, bytes of int64) of equal keys, as they stream by in order."""
    kind = ", ".join([f"{k} int" for k in keys] + ["counts binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(keys, at)) | {"counts": total.tobytes()}], pa.schema([*[(k, pa.int32()) for k in keys], ("counts", pa.binary())]))

        for b in batches:
            for i in range(b.num_rows):
                own = tuple(b.column(k)[i].as_py() for k in keys)
                counts = np.frombuffer(b.column("counts")[i].as_buffer(), np.int64)
                if own == at:
                    total += counts
                else:
                    if at is not None:
                        yield made()
                    at, total = own, counts.copy()
        if at is not None:
            yield made()

    return arrays.repartition(partitions(arrays.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def frequencies(rows: DataFrame, words: int, tables: list[Table]) -> DataFrame:
    """level, slot, a: how often the phrases of ``level`` words occur, of all slots of the words and the tables."""
    sizes = [words, *map(len, tables)]
    pieces = [(level, k) for level, size in enumerate(sizes, 1) for k in range(math.ceil(size / PIECE))]
    step = max(1, ROUND // PIECE)
    counted = []
    for at in range(0, len(pieces), step):
        wanted = pieces[at : at + step]

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            branch = TaskContext.get().partitionId() % BRANCHES
            # the range of pieces of each level
            spans = {level: [min(k for n, k in wanted if n == level), max(k for n, k in wanted if n == level) + 1] for level, _ in wanted}
            totals = {level: np.zeros((hi - lo) * PIECE, np.int64) for level, (lo, hi) in spans.items()}
            for slots in _arrays(batches):
                for level in range(1, max(spans) + 1):
                    slots = slots if level == 1 else _longer(slots, tables[level - 2])
                    if level in spans:
                        lo, hi = (x * PIECE for x in spans[level])
                        totals[level] += np.bincount(slots[(slots >= lo) & (slots < hi)] - lo, minlength=hi - lo)
            for level, k in wanted:
                lo = (k - spans[level][0]) * PIECE
                yield pa.RecordBatch.from_pylist([{"level": level, "piece": k, "branch": branch, "counts": totals[level][lo : lo + PIECE].tobytes()}], schema)

        schema = pa.schema([("level", pa.int32()), ("piece", pa.int32()), ("branch", pa.int32()), ("counts", pa.binary())])
        counted.append(rows.mapInArrow(run, "level int, piece int, branch int, counts binary"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                counts = np.frombuffer(b.column("counts")[i].as_buffer(), np.int64)
                at = np.flatnonzero(counts)
                slot = at + b.column("piece")[i].as_py() * PIECE
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b.column("level")[i].as_py(), np.int32)), pa.array(slot), pa.array(counts[at])], ["level", "slot", "a"])

    every = reduce(DataFrame.unionAll, counted)
    return _added(_added(every, "level", "piece", "branch").drop("branch"), "level", "piece").mapInArrow(read, "level int, slot long, a long")


def _score(a: Column, both: Column) -> Column:
    """floor(SCALE * a / both), exact: the product may pass 64 bits."""
    return F.expr(f"CAST(CAST({SCALE} AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0)) DIV CAST({both} AS DECIMAL(20,0)) AS LONG)")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's TOP phrases.

    A-Z count as a-z; texts fall into pieces at ``[.,;:!?\\n-\\r]`` and those into words at blanks and tabs. A phrase of 2 to
    LONGEST words that occurs a >= FREQUENT times (overlaps included) scores floor(SCALE * a / (l + r)) at the cut where
    that is least (of equal ones the first), l and r being how often its parts occur. One that lies in a longer one which
    occurs 80 % as often isn't returned. n counts the language's words. Ties go by a, then by the phrase's UTF-8 bytes.

    A null lang counts as "und", a null text as empty; texts are read whole, however long; repeated rows count each; other
    columns are not read; an empty table, or one without frequent phrases, gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(PLAIN)).alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("raw"))
    every = materialize(count_words(own), "words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = every.filter(F.col("n") >= FREQUENT).select("lang", "word")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                key, second = _word_keys(lang, [bytes(w) for w in part["word"]])
                yield part.assign(key=key, second=second)

    made = build(materialize(frequent.mapInPandas(keyed, "lang string, word binary, key long, second long"), "frequent-words"), ["lang", "word"], "second")
    none = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    if made is None:
        return none
    words, named = made
    rows = materialize(_numbered(own, words), "word-slots")
    tables, phrases = [], []
    while len(tables) < LONGEST - 1:
        made = build(materialize(candidates(rows, tables), f"phrases-{len(tables) + 2}"), [])
        if made is None:
            break
        tables.append(made[0])
        phrases.append(made[1])
    if not tables:
        return none
    counts = materialize(frequencies(rows, len(words), tables), "frequencies")
    often = lambda level, slot, name: counts.filter(F.col("level") == level).select(F.col("slot").alias(slot), F.col("a").alias(name))
    # of each level its slots, the slots of what is in it (w: words, p: pairs, t: triples, by place), and their frequencies
    first, last = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    levels = [phrases[0].select("slot", first.alias("w1"), last.alias("w2")).join(often(2, "slot", "a"), "slot").join(often(1, "w1", "l1"), "w1").join(often(1, "w2", "r1"), "w2")]
    levels[0] = materialize(levels[0], "pairs")
    if len(tables) > 1:
        p, s = (levels[0].select(F.col("slot").alias(f"p{i}"), *[F.col(f"w{k}").alias(f"w{k + i - 1}") for k in (1, 2) if k + i - 1 not in got], *extra) for i, got, extra in ((1, (), [F.col("a").alias("l2"), F.col("l1")]), (2, (2,), [F.col("a").alias("r1"), F.col("r1").alias("r2")])))
        levels.append(materialize(phrases[1].select("slot", first.alias("p1"), last.alias("p2")).join(often(3, "slot", "a"), "slot").join(p, "p1").join(s, "p2"), "triples"))
    if len(tables) > 2:
        triple = levels[1].select(F.col("slot").alias("t1"), "p1", "p2", "w1", "w2", "w3", F.col("a").alias("l3"), "l2", "l1")
        after = levels[1].select(F.col("slot").alias("t2"), F.col("p2").alias("p3"), F.col("w3").alias("w4"), F.col("a").alias("r1"), F.col("r1").alias("r2"), F.col("r2").alias("r3"))
        levels.append(materialize(phrases[2].select("slot", first.alias("t1"), last.alias("t2")).join(often(4, "slot", "a"), "slot").join(triple, "t1").join(after, "t2"), "fours"))
    inside = [levels[k].select(F.lit(level).alias("level"), F.col(c).alias("slot"), "a") for k in range(1, len(levels)) for level, names in ((2, ("p1", "p2", "p3")), (3, ("t1", "t2"))) for c in names if c in levels[k].columns]
    scored = []
    for k, rows_of in enumerate(levels, 2):
        cuts = [F.struct(_score("a", f"(l{i} + r{i})").alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, k)]
        places = F.array(*[F.col(f"w{i}") if i <= k else F.lit(None).cast("long") for i in range(1, LONGEST + 1)])
        scored.append(rows_of.select(F.lit(k).alias("level"), "slot", "a", places.alias("places"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")))
    found = reduce(DataFrame.unionAll, scored)
    if inside:
        longest = reduce(DataFrame.unionAll, inside).groupBy("level", "slot").agg(F.max("a").alias("longer"))
        found = found.join(longest, ["level", "slot"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * COVERED))
    for i in range(1, LONGEST + 1):
        word = named.select(F.col("slot").alias(f"at{i}"), F.col("word").cast("string").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))
        found = found.withColumn(f"at{i}", F.get("places", F.lit(i - 1))).join(word, f"at{i}", "left")
    found = found.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(1, LONGEST + 1)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("rank") <= TOP)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) t(k))
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING f >= {FREQUENT}),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
    SELECT c.*, cut, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, {LONGEST}) t(m) WHERE m < k) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score
      FROM cuts c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
JOIN totals USING (lang) WHERE rank <= {TOP}
"""

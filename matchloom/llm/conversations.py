"""Conversation structure repair (operator 12).

A conversation is to read (s?(ua)+)?: perhaps a system turn, then user and assistant in turn. The cheapest edits are a
shortest path in the lattice of (turn index, grammar state), found by Dijkstra over the nodes as they are reached, with
(cost, audit) as priority. Two audits of one cost that lead to one node are never one the start of the other (what is
longer by inserts costs more), so the order of two paths is that of their extensions.

Conversations are sorted in ranges of (conv_id, turn). One that lies whole in a range is repaired there. One that goes
over the edge of its range, or is long, is cut at the ranges: each part gives its cheapest audits from every state to
every state, and neighbouring parts are put together by their sums. No task holds more than a range's rows of it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, partitions

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What may follow in each state: nothing yet, after system, after user, after assistant. It may end in ACCEPTING.
NEXT, ACCEPTING = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: Rows and characters of a conversation that a task holds at once; rows of a lattice; rows of an Arrow batch.
LONG, LONG_TEXT, SEGMENT, BATCH = 2_000, 4_000_000, 256, 1_000
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Choice = tuple[int, str]  # cost and audit


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``present`` of the damaged rows, by crc32("conv_id:turn") mod 20: 0 isn't present any
    more, 1 has an empty text, 2 no sentence ends, 3 is there twice, 4 is the user's. Nulls count as one space; rows of
    equal conv_id and turn are damaged alike. Other columns are not read; an empty table stays empty."""
    c = conversations
    filled = lambda name: F.coalesce(c[name].cast("string"), F.lit(" "))
    rows = c.select(c["conv_id"], c["turn"], filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), twice.alias("copy")).drop("copy")


def shortest(rows: list[tuple[str, str]], start: int, whole: bool) -> dict[int, Choice]:
    """Cheapest (cost, audit) from a state before rows (initial, fault) to each state after them; with ``whole`` only to
    the first accepting end that is reached."""
    heap, closed, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows):
            if whole and state in ACCEPTING:
                return {state: (cost, audit)}
            found[state] = cost, audit
        else:
            initial, fault = rows[i]
            if fault not in ("blank", "duplicate"):
                stays = cost + TRUNCATED * (fault == "truncated")
                if initial in NEXT[state]:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, NEXT[state][initial]))
                for to in ROLES:
                    if to in NEXT[state]:
                        heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, NEXT[state][to]))
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        for to in ROLES:
            if to in NEXT[state]:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][to]))
    return found


Paths = dict[int, dict[int, Choice]]  # from each state, to each state


def follow(first: Paths, second: Paths) -> Paths:
    """The cheapest ways through two neighbouring parts."""
    out: Paths = {}
    for start, ways in first.items():
        best: dict[int, Choice] = {}
        for mid, (cost, audit) in ways.items():
            for end, (more, rest) in second[mid].items():
                way = cost + more, audit + rest
                if end not in best or way < best[end]:
                    best[end] = way
        out[start] = best
    return out


def paths(rows: list[tuple[str, str]]) -> Paths:
    return {s: shortest(rows, s, False) for s in range(len(NEXT))}


class Joined:
    """The product of parts that come in order, put together as a balanced tree: audits are copied log(n) times."""

    def __init__(self):
        self.held: list[tuple[int, Paths]] = []

    def add(self, part: Paths) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            part, size = follow(self.held.pop()[1], part), 2 * size
        self.held.append((size, part))

    def result(self) -> Paths:
        parts = [p for _, p in self.held] or [paths([])]
        out = parts.pop()
        while parts:
            out = follow(parts.pop(), out)
        return out


class Summary:
    """Counts over rows in order, of neighbouring parts added up."""

    def __init__(self, values: dict | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.__dict__.update(values or {})

    def see(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.add(Summary({"turns": int(turn is not None), "low": turn, "high": turn, "first": initial, "last": initial}))

    def add(self, after: Summary) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + after.blank, self.duplicate + after.duplicate, self.truncated + after.truncated
        self.illegal += after.illegal + (self.last is not None and after.first is not None and self.last + after.first not in LEGAL)
        self.turns += after.turns - (after.low is not None and self.high == after.low)  # turns ascend
        self.first, self.last = after.first if self.first is None else self.first, self.last if after.last is None else after.last
        self.low, self.high = after.low if self.low is None else self.low, self.high if after.high is None else after.high

    def counts(self, cost: int) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(COUNTS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)))


def flaw(text: str) -> str:
    body = text.rstrip(SPACE)
    return "blank" if not body else "" if body[-1] in ENDS else "truncated"


def cheapest(found: dict[int, Choice]) -> Choice:
    return min(way for state, way in found.items() if state in ACCEPTING)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that an audit makes of the rows; it alone says what role each has."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            initial = role[:1] if edit == "K" else "a" if "a" in NEXT[state] else "u"
            state = NEXT[state][initial]
            yield role if edit == "K" else ROLES[initial], text


def digest(turns: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of ``role:text``, newline-joined."""
    h, between = hashlib.sha256(), b""
    for role, text in turns:
        h.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        between = b"\n"
    return h.hexdigest()


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of equal keys that follow each other, as they come."""
    rows = (r for b in batches for at in range(0, b.num_rows, BATCH) for r in b.slice(at, BATCH).to_pylist())
    return itertools.groupby(rows, lambda r: tuple(r[k] for k in keys))


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(held, schema)


def _ranges(rows: DataFrame) -> DataFrame:
    """A result for each conversation that lies whole in its range; of others the rows, with their place (part, at)."""
    kind = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tie", T.StringType()), T.StructField("present", T.BooleanType())])
    schema = to_arrow_schema(kind)

    def whole(conv, rows: list[dict]) -> dict:
        seen, about, lattice = set(), Summary(), []
        rows = [r for r in rows if r["present"]]
        for r in rows:
            fault, turn = flaw(r["text"]), (r["role"], r["text"])
            fault = "duplicate" if fault != "blank" and turn in seen else fault
            seen.add(turn)
            lattice.append((r["role"][:1], fault))
            about.see(r["turn"], r["role"][:1], fault)
        cost, audit = cheapest(shortest(lattice, 0, True))
        return {"conv_id": conv, **about.counts(cost), "audit": audit, "sha256": digest(repaired(audit, ((r["role"], r["text"]) for r in rows)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            before, number = None, itertools.count()  # the conversation before, held until another follows
            for k, ((conv,), rows) in enumerate(_runs(batches, "conv_id")):
                if before is not None:
                    yield whole(*before)
                    before = None
                held, size, edge = [], 0, k == 0
                for r in rows:
                    held.append(r | {"part": part, "at": next(number)})
                    size += len(r["text"])
                    if edge or len(held) > LONG or size > LONG_TEXT:
                        edge = True
                        yield from held
                        held, size = [], 0
                if not edge:
                    before = conv, held
            if before is not None:  # the last may go on in the next range
                yield from before[1]

        yield from _batched(out(), schema)

    return rows.mapInArrow(run, kind)


def _parts(rows: DataFrame) -> DataFrame:
    """conv_id, part, and the summary and paths of a conversation's rows in a range."""
    kind = T.StructType([rows.schema["conv_id"], rows.schema["part"], *[T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")], T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("ways", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])))])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for (conv, part), rows in _runs(batches, "conv_id", "part"):
                about, joined = Summary(), Joined()
                rows = (r for r in rows if r["present"])
                while held := list(itertools.islice(rows, SEGMENT)):
                    faults = ["duplicate" if r["again"] and r["flaw"] != "blank" else r["flaw"] for r in held]
                    for r, fault in zip(held, faults):
                        about.see(r["turn"], r["initial"], fault)
                    joined.add(paths([(r["initial"], fault) for r, fault in zip(held, faults)]))
                ways = [{"start": s, "end": e, "cost": c, "audit": a} for s, to in joined.result().items() for e, (c, a) in to.items()]
                yield {"conv_id": conv, "part": part, **about.__dict__, "ways": ways}

        yield from _batched(out(), schema)

    return rows.mapInArrow(run, kind)


def _put_together(parts: DataFrame, rows: DataFrame, spread: int) -> DataFrame:
    """A result for each conversation from its parts, one a range at most, and its rows, which stream by in order."""
    both = parts.withColumn("at", F.lit(-1).cast("long")).unionByName(rows.select("conv_id", "part", "at", "role", "text"), allowMissingColumns=True)
    both = both.withColumn("later", F.col("at") >= 0)
    kind = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType())])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for (conv,), rows in _runs(batches, "conv_id"):
                about, joined, row = Summary(), Joined(), None
                for row in rows:
                    if row["later"]:
                        break
                    about.add(Summary({k: row[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}))
                    ways: Paths = {}
                    for w in row["ways"]:
                        ways.setdefault(w["start"], {})[w["end"]] = w["cost"], w["audit"]
                    joined.add(ways)
                    row = None
                cost, audit = cheapest(joined.result()[0])
                turns = itertools.chain([row] if row else [], rows)
                yield {"conv_id": conv, **about.counts(cost), "audit": audit, "sha256": digest(repaired(audit, ((r["role"], r["text"]) for r in turns)))}

        yield from _batched(out(), schema)

    return both.repartition(spread, "conv_id").sortWithinPartitions("conv_id", "later", "part", "at").mapInArrow(run, kind)


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost (long), audit and sha256 of the repaired turns.

    Rows are taken by turn (nulls first), then role, then the SHA-256 of the text. Nulls in role and text count as one
    space; a null conv_id is one conversation. Of a row's faults the first counts: blank, duplicate (role and text seen
    before in the conversation, repeated rows with it), truncated. gaps are the turns that lack between the first and the
    last. Rows that aren't ``present`` are no part of a conversation, which is returned all the same: without rows all
    is zero, the audit empty and the digest that of no bytes. Texts are read whole, however long; other columns are not
    read; an empty table gives no rows. See apply_audit() for the repaired turns.

    The digest is one hash over all of a conversation's turns, so a conversation's texts pass through one task, row by row.
    """
    spread, filled = partitions(rows.sparkSession), lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    tied = rows.select("conv_id", rows["turn"].cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), F.sha2(filled("text"), 256).alias("tie"), there.alias("present"))
    order = ["conv_id", "turn", "role", "tie", "any"]
    dealt = tied.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(spread, *order).sortWithinPartitions(*order)
    done = materialize(_ranges(dealt.drop("any")), "conversation-ranges")
    held = done.filter("part IS NOT NULL").select("conv_id", "part", "at", "turn", "role", "text", "tie", "present")
    flat = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    flaws = F.when(flat == "", "blank").when(F.right(flat, F.lit(1)).isin(*ENDS), "").otherwise("truncated")
    small = held.select("conv_id", "part", "at", "turn", F.substring("role", 1, 1).alias("initial"), flaws.alias("flaw"), "role", "tie", "present")
    seen = small.filter("present").groupBy("conv_id", "role", "tie").agg(F.min(F.struct("part", "at")).alias("seen"))
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tie").alias("t"), "seen")
    again = small.join(seen, small["conv_id"].eqNullSafe(seen["c"]) & (small["role"] == seen["r"]) & (small["tie"] == seen["t"]), "left")
    again = again.select("conv_id", "part", "at", "turn", "initial", "flaw", "present", (F.struct("part", "at") > F.col("seen")).alias("again"))
    parts = _parts(again.repartition(spread, "conv_id", "part").sortWithinPartitions("conv_id", "part", "at"))
    across = _put_together(parts, held.filter("present"), spread)
    return done.filter("part IS NULL").select(*across.columns).unionByName(across)


def apply_audit(rows: DataFrame, audits: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, position (0, 1, ...), role and text of the repaired turns, by the audits (conv_id, audit) that repair() gave for
    the same rows. A conversation's rows stream through one task in order; nothing is held but its audit."""
    spread, filled = partitions(rows.sparkSession), lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = rows.filter(F.lit(True) if present is None else F.coalesce(present, F.lit(False)))
    own = own.select("conv_id", rows["turn"].cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), F.sha2(filled("text"), 256).alias("tie"), F.lit(True).alias("later"))
    both = audits.select("conv_id", "audit", F.lit(False).alias("later")).unionByName(own, allowMissingColumns=True)
    kind = T.StructType([audits.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for (conv,), rows in _runs(batches, "conv_id"):
                audit = next(rows)["audit"]
                for k, (role, text) in enumerate(repaired(audit, ((r["role"], r["text"]) for r in rows))):
                    yield {"conv_id": conv, "position": k, "role": role, "text": text}

        yield from _batched(out(), schema)

    return both.repartition(spread, "conv_id").sortWithinPartitions("conv_id", "later", "turn", "role", "tie").mapInArrow(run, kind)


#: The damage, the faults and the cheapest edits as a recursion over the turns. s0 to s3 are the cheapest {cost, audit,
#: turns so far} in each state of the grammar; an insert leads on from a state, and from there a second one.
def _way(state: str, cost: str, letter: str, turn: str) -> str:
    joined = f"CASE WHEN {state}.out IS NULL THEN {turn} ELSE {state}.out || chr(10) || {turn} END" if turn else f"{state}.out"
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'out': {joined}}} END"


def _cheapest(ways: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _oracle() -> str:
    keep = lambda s: _way(s, "stays", "K", "role || ':' || text")
    rerole = lambda s, to: _way(s, "stays + 1", "R", f"'{to}:' || text")
    delete = lambda s: _way(s, "2", "D", "")
    insert = lambda s, to: _way(s, "5", "I", f"'{to}:'")
    when = lambda initial, way: f"CASE WHEN ok AND initial = '{initial}' THEN {way} END"
    if_ok = lambda way: f"CASE WHEN ok THEN {way} END"
    rows = {
        0: [delete("s0")],
        1: [delete("s1"), when("s", keep("s0"))],
        2: [delete("s2")] + [when("u", keep(s)) for s in ("s0", "s1", "s3")] + [if_ok(rerole(s, "user")) for s in ("s0", "s1", "s3")],
        3: [delete("s3"), when("a", keep("s2")), if_ok(rerole("s2", "assistant"))],
    }
    stepped = ", ".join(f"{_cheapest(w)} AS s{s}" for s, w in rows.items())
    # two inserts lead round the cycle of user and assistant, three from it to itself, which never pays
    once = f"s0, s1, {_cheapest(['s2', *[insert(s, 'user') for s in ('s0', 's1', 's3')]])} AS s2, {_cheapest(['s3', insert('s2', 'assistant')])} AS s3"
    return f"""
WITH RECURSIVE bits(b, v, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS steps FROM bits WHERE k = 8),
named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named
    FROM conversations
), marked AS (
    SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(named, ''), lambda c: ord(c)::BIGINT)),
                                lambda x, c: xor(x >> 8, steps[(xor(x, c) & 255) + 1])), 4294967295) % 20 AS fault
    FROM named n, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM marked, range(2) t(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
           rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS body, left(role, 1) AS initial
    FROM damaged
), flagged AS (
    SELECT *, CASE WHEN body = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS flaw,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM numbered
), turns AS (SELECT *, flaw NOT IN ('blank', 'duplicate') AS ok, CASE flaw WHEN 'truncated' THEN 5 ELSE 0 END AS stays FROM flagged),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (flaw = 'blank') AS blank,
           count(*) FILTER (flaw = 'duplicate') AS duplicate, count(*) FILTER (flaw = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id
), step AS (
    SELECT conv_id, n, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'out': NULL::VARCHAR}} AS s0,
           NULL::STRUCT(cost INTEGER, audit VARCHAR, out VARCHAR) AS s1, NULL::STRUCT(cost INTEGER, audit VARCHAR, out VARCHAR) AS s2, NULL::STRUCT(cost INTEGER, audit VARCHAR, out VARCHAR) AS s3
    FROM counted
    UNION ALL
    SELECT conv_id, n, i, {stepped}
    FROM (SELECT conv_id, n, i, role, text, initial, ok, stays, {once}
          FROM (SELECT p.conv_id, n, t.i, role, text, initial, ok, stays, {once}
                FROM step p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1))
), ended AS (
    SELECT conv_id, {_cheapest(['s0', 's3'])} AS best FROM (SELECT conv_id, {once} FROM (SELECT conv_id, {once} FROM step WHERE i = n))
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()

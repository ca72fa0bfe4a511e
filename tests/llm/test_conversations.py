"""Repaired conversations against all edits tried one by one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from matchloom.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")


def brute_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_repairs(rows, faults, inserts):
    """(cost, audit, turns) of every sequence of edits with so many inserts at most."""
    def edits(i, left):
        if left:
            for role in ("user", "assistant"):
                yield from ((5 + c, "I" + a, [(role, ""), *t]) for c, a, t in edits(i, left - 1))
        if i == len(rows):
            yield 0, "", []
            return
        _, role, text = rows[i]
        choices = [(2, "D", [])]
        if faults[i] not in ("blank", "duplicate"):
            more = 5 * (faults[i] == "truncated")
            choices += [(more, "K", [(role, text)]), (1 + more, "R", [("user", text)]), (1 + more, "R", [("assistant", text)])]
        for cost, letter, turn in choices:
            yield from ((cost + c, letter + a, turn + t) for c, a, t in edits(i + 1, left))

    return ((c, a, t) for c, a, t in edits(0, inserts) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in t)))


def brute(rows, inserts=2):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults = brute_faults(rows)
    cost, audit, turns = min(all_repairs(rows, faults, inserts), key=lambda x: x[:2])
    turn = {t for t, _, _ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turn) - min(turn) + 1 - len(turn) if turn else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def made(rng, n):
    texts = ["Yes.", "no", "Why?", " \n", "", "ok! \t", "thé end.", "Yes.", "a\nb."]
    return [(rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "update"]), rng.choice(texts)) for _ in range(n)]


def got(rows, **more):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repair(rows, **more).collect()}


@pytest.mark.parametrize("long, segment", [(2_000, 256), (0, 2), (1, 1)])
def test_repairs_are_the_cheapest(spark, monkeypatch, long, segment):
    """Whole conversations, and conversations cut into ranges and segments, against all edits."""
    monkeypatch.setattr(conversations, "LONG", long)
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rng = random.Random(6)
    convs = {c if c else None: made(rng, rng.randint(1, 5)) for c in range(60)}
    rows = spark.createDataFrame([(c, *r, "x") for c, own in convs.items() for r in own], "conv_id long, turn long, role string, text string, part string")
    assert got(rows) == {c: brute(own) for c, own in convs.items()}
    assert got(rows.repartition(7)) == got(rows)


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    """A third of all rows, some of them equal in all columns, is the same in one piece and cut at the edges of ranges."""
    rng = random.Random(7)
    long = [(i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"text {i}.", f"text {i}"])) for i in range(600)] + [(700, "user", "Same.")] * 80
    rows = spark.createDataFrame([(1, *r) for r in long] + [(c, *r) for c in range(2, 250) for r in made(rng, 5)], "conv_id long, turn long, role string, text string")
    cut = got(rows)[1]
    monkeypatch.setattr(conversations, "partitions", lambda spark: 1)
    monkeypatch.setattr(conversations, "LONG", 10**6)
    ends = spark.createDataFrame([(0, 0, "user", "Hm."), (9, 0, "user", "Hm.")], "conv_id long, turn long, role string, text string")
    whole = got(rows.filter("conv_id = 1").union(ends))[1]
    assert cut == whole and cut[5] > 0
    monkeypatch.undo()
    turns = [(r.role, r.text) for r in conversations.apply_audit(rows, conversations.repair(rows)).filter("conv_id = 1").orderBy("position").collect()]
    assert conversations.digest(iter(turns)) == cut[7] and GRAMMAR.fullmatch("".join(r[0] for r, _ in turns))


def test_damage(spark):
    rows = [(c, t, r, x) for (c, t), (r, x) in zip(itertools.product([*range(40), None], [*range(6), None]), itertools.cycle([("user", "A. b?"), ("assistant", None), (None, "c!")]))]
    want = []
    for c, t, r, x in rows:
        named = f"{' ' if c is None else c}:{' ' if t is None else t}"
        k, r, x = zlib.crc32(named.encode()) % 20, r or " ", x or " "
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(df)
    some = sorted((tuple(r)[:4] for r in damaged.filter("present").collect()), key=str)
    assert some == sorted(want, key=str)
    found = got(damaged, present=F.col("present"))
    by = {c: [r[1:] for r in want if r[0] == c] for c in [*range(40), None]}
    assert set(found) == set(by)
    for c, own in by.items():
        if len(own) <= 5:
            assert found[c] == brute(own)


def test_nothing_left(spark):
    rows = spark.createDataFrame([(5, 1, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(rows, present=F.lit(False)) == {5: empty}
    assert got(rows.limit(0)) == {} and conversations.damage(rows.limit(0)).count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "x" * 5_000_000 + "?"), (1, 1, "assistant", "y " * 2_000_000 + "."), (1, 2, "user", "x" * 5_000_000 + "?")]
    found = got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found[1][2] == 1 and found[1][6] == "KKD"

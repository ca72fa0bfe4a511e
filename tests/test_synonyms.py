"""Synonyms in names against a plain loop for the longest match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchloom.operators import synonyms


def brute(name, table, lemmas=None, forms=None, longest=4):
    """Words left to right, the longest phrase first."""
    parts, out, i = re.findall(r"[^\W\d_]+|(?:[\W\d_])+", name.lower()), [], 0
    lemmas = lemmas or {}
    while i < len(parts):
        for n in range(longest, 0, -1):
            words, gaps = parts[i : i + 2 * n - 1 : 2], parts[i + 1 : i + 2 * n - 1 : 2]
            if len(words) < n or not all(w.isalpha() for w in words) or any(g != " " for g in gaps):
                continue
            new = table.get(" ".join(lemmas.get(w, (w, None))[0] for w in words), table.get(" ".join(words)))
            if new is not None:
                out.append((forms or {}).get((new, lemmas.get(words[-1], (None, None))[1]), new))
                i += 2 * n - 1
                break
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_longest_match(spark, longest):
    rng = random.Random(4)
    vocabulary = ["цвет", "корпуса", "вес", "net", "gross", "max", "ширина", "a"]
    name = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", "  ", "-", " 12 "]) for _ in range(rng.randint(1, 7)))
    names = sorted({name() for _ in range(300)} | {"", " ", "12", "Цвет КОРПУСА"})
    table = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))): f"r{i} x" for i in range(40)}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (names[3],)], "name string")
    found = {r.name: r.normalized for r in synonyms.normalize_names(df, spark.createDataFrame(list(table.items()), "phrase string, replacement string"), longest=longest).collect()}
    assert found == {n: brute(n, table, longest=longest) for n in names}


def test_lemmas_and_forms(spark):
    words = [("весом", "вес", "ablt"), ("вес", "вес", "nomn"), ("массой", "масса", "ablt"), ("масса", "масса", "nomn"), ("нетто", "нетто", None), ("цвета", "цвет", "gent"), ("цвет", "цвет", "nomn")]
    table = {"вес": "масса", "цвета": "окраска", "вес нетто": "чистая масса"}
    lemmas, forms = {w: (base, t) for w, base, t in words}, {(base, t): w for w, base, t in words if t}
    names = ["Весом до 5 кг", "вес", "Цвета корпуса", "цвет", "весом нетто, вес", "нечто"]
    morphology = spark.createDataFrame(words, "word string, lemma string, tags string")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r.name: r.normalized for r in synonyms.normalize_names(df, spark.createDataFrame(list(table.items()), "phrase string, replacement string"), morphology).collect()}
    assert found == {n: brute(n, table, lemmas, forms) for n in names}
    assert found["Весом до 5 кг"] == "массой до 5 кг" and found["весом нетто, вес"] == "чистая масса, масса" and found["Цвета корпуса"] == "окраска корпуса"


def test_table_from_groups_and_renaming(spark):
    groups = spark.createDataFrame([("Масса", ["Вес", None]), ("Аб", ["вес"]), (None, ["x"]), ("Z", None)], "replacer string, synonyms array<string>")
    table = synonyms.synonym_table(groups)
    assert [tuple(r) for r in table.collect()] == [("вес", "аб")]
    rows = spark.createDataFrame([(1, [("Вес", "5"), ("аб", "6"), ("цвет", "red")], 9), (2, [], 8), (3, None, 7)], "i int, attributes array<struct<k:string,v:string>>, name int")
    names = synonyms.normalize_names(rows.select(F.explode("attributes.k").alias("name")), table)
    found = {r.i: (r.attributes and [(a.k, a.v) for a in r.attributes], r["name"]) for r in synonyms.rename_by_table(rows, "i", "attributes", names).collect()}
    assert found == {1: ([("аб", "5"), ("цвет", "red")], 9), 2: ([], 8), 3: (None, 7)}
    with pytest.raises(ValueError, match="one word"):
        synonyms.normalize_names(names.select("name"), table, longest=0)

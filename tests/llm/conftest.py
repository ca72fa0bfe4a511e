import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, kept boolean, row string, position double"


def words(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ter", "un", "sch", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, repeats, and columns that operators use as well."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(20, 80)) + "." for _ in range(40)]
    texts += ["", None, " \n\t ", "one", "two words", "A  b\n\n c  ", "$$$ %%% ***" * 9, words(rng, 6000), "日本語テキスト" * 20, "x" * 3000, texts[0], texts[0], texts[1].upper()]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "ü")[i % 4], None if t is None else len(t), 7, 8, False, "r", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here but words", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)

import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, start long, size string, ids string, kept string, block string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = sentence(rng, 20_000)
    texts = [None, "", " \n\t", "one", "two words", long, long, "AKIA" + "A" * 16, "a b c d e", "A  B\nC d e", "# $ % & |", "x\n" * 30, "caña ñandú straße 日本語 \U0001f600"]
    texts += [sentence(rng, rng.randint(5, 120)) for _ in range(40)]
    base = texts[-1].split()
    texts += [" ".join(base[:i] + ["zzz"] + base[i + 1 :]) for i in (0, len(base) // 2, len(base) - 1)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t else None, 1, "s", "i", "k", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def null_row(spark):
    return spark.createDataFrame([(None,) * 10, (7, "some text here", *[None] * 8), (7, "some text here", *[None] * 8)], SHAPE)

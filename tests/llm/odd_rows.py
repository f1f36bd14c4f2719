"""Odd documents that every operator must take."""

import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, k string, n string, words string, start long, label string"


def rows_of(texts, lang="en"):
    return [(i, t, lang, "s", len(t or ""), "k", "n", "w", 1, "l") for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma-", "délta", "eta,", "zeta", "AKIA", "naïve", "ΣΑΣ", "全角", "x"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "x"), (5, long), (6, plain[0]), (6, plain[0]), (7, plain[0]), (None, plain[1]), (8, "0123 ... !!")]
    texts += [(20 + i, t) for i, t in enumerate(plain)]
    texts += [(60, "a\nb\n\na\nb\n a\n"), (61, "one two three four five six seven eight nine " * 4), (62, " lead  and\n trail   ")]
    return texts


@pytest.fixture
def odd(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), KINDS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], KINDS)

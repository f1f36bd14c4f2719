"""The Jaccard join against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallygrade.llm.jaccard import jaccard_components, one_of_each

KINDS = "doc_id long, text string, source string"


def expected(rows, k, percent):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        common = len(sets[x] & sets[y])
        if sets[x] and sets[y] and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n, edits):
    """Chains of near copies, hot lines and short texts from few words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    hot = " ".join(rng.choice(words) for _ in range(25))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6 and texts:
            w = rng.choice(texts[-12:]).split()
            for _ in range(rng.randint(0, edits)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.8:
            texts.append(hot + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 8, 60]))))
    return [(i * 3, t if t or i % 2 else None, "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, k, percent, edits", [(1, 3, 90, 2), (2, 2, 60, 6), (3, 5, 80, 2)])
def test_all_pairs(spark, seed, k, percent, edits):
    rows = corpus(seed, 160, edits)
    got = jaccard_components(spark.createDataFrame(rows, KINDS), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, k, percent)
    assert len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(1, "A b c d", "x"), (1, "a B c d", "x"), (2, "a b c d", None), (None, "a b c d", "x"), (4, None, "x"), (5, "", "x"), (6, " \t\n", "x")]
    got = jaccard_components(spark.createDataFrame(rows, KINDS), 3, 90).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [
        (-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6),
    ]
    kept = one_of_each(spark.createDataFrame(rows, KINDS).withColumn("n", F.lit(1)), 3, 90)
    assert kept.columns == ["doc_id", "text", "source", "n"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [1, 4, 5, 6]


def test_one_doc_id_with_different_texts(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "ten nine eight seven six"
    kinds = "doc_id long, text string, t string, c string, _key string, k string"
    rows = [(7, a), (7, b), (9, a), (9, a), (None, c), (None, c), (None, b), (None, ""), (None, None), (3, None), (3, None), (3, "")]
    rows += [(20 + i, a) for i in range(40)]
    table = spark.createDataFrame([(*r, "t", "c", "y", "k") for r in rows], kinds)
    kept = one_of_each(table, 3, 90)
    assert kept.columns == table.columns and {tuple(r[2:]) for r in kept.collect()} == {("t", "c", "y", "k")}
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(7, a), (7, b), (None, c), (None, ""), (None, None), (3, None), (3, "")], key=repr)
    assert one_of_each(table.where("false"), 3, 90).collect() == []


def test_a_large_group_of_near_copies(spark):
    """A common passage in all texts, each with a few words of its own: no token holds pairs of its own group."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join([*passage[: 50 + i % 3], f"own{i}"]), "s") for i in range(3000)]
    rows += [(5000 + i, " ".join([*passage[:20], *[rng.choice(words) for _ in range(40)]]), "s") for i in range(300)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, KINDS), 3, 90).collect()}
    assert {got[i] for i in range(3000)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(300))


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], KINDS), 3, 90).collect() == []

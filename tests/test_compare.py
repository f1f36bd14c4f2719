import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import pairs, raw, tagged, RAW
from tallygrade.operators.columns import fingerprints, value_classes
from tallygrade.operators.compare import compare
from tallygrade.operators.mapping import options_of, search
from tallygrade.operators.positions import tie_runs


def run(spark, cases, **kw):
    out = compare(*pairs(spark, cases), **kw).collect()
    assert len(out) == len(cases)
    return {r["case_id"]: r for r in out}


DAY = dt.date(1987, 11, 30)

EQUAL = [
    ("90210", 90210), ("7.250", 7.25), ("$3,014.15", 3014.15), ("-$88,000.75", -88000.75), ("2.5e2", 250), (-0.0, 0),
    (0.7 + 0.1, 0.8), (1234.56780000001, 1234.5678), (False, 0), (None, None), ("NaN", float("nan")),
    ("1987-11-30T00:00:00.000Z", DAY), ("1987-11-30", dt.datetime(1987, 11, 30)), ("2003-07-09T23:59:00.000Z", dt.datetime(2003, 7, 9, 23, 59)),
    ("2019-12-31 07:45", "2019-12-31 07:45:00"), ("\tNorth Sea ", "north sea"), ("Öl", "ÖL"),
]
DIFFERENT = [
    ("", None), (0, None), ("", 0), ("4,5,6", 456), (2.25, 2.35), (DAY, dt.date(1987, 12, 1)), ("2019-12-31 07:45:00+03:00", "2019-12-31 04:45:00"),
]


def test_cells(spark):
    for wanted, values in ((True, EQUAL), (False, DIFFERENT)):
        df = spark.createDataFrame([(raw(a), raw(b), repr((a, b))) for a, b in values],
                                   "a struct<s:string,d:double,day:date,ts:timestamp_ntz,b:boolean,bin:binary>,"
                                   "b struct<s:string,d:double,day:date,ts:timestamp_ntz,b:boolean,bin:binary>, r string")
        got = df.select("r", tagged(F.col("a")).alias("x"), tagged(F.col("b")).alias("y")).collect()
        for r in got:
            if r["r"].startswith("(b'"):
                continue  # bytes become hex text, which may look like a number
            assert (r["x"] == r["y"]) is wanted, r


def test_reasons(spark):
    cases = [
        dict(id="names", e=[["mon", 7.5], ["tue", 9.25], ["wed", 1.0]], g=[["9.250", "Tue"], ["1", "WED"], ["7.50", "mon"]]),
        dict(id="flags", e=[[1, "k"], [0, "l"], [0, "m"]], g=[[0, 1, "k"], [1, 0, "l"], [1, 0, "m"]]),
        dict(id="pairing", e=[[8, "u"], [9, "v"], [7, "w"]], g=[[8, "v"], [9, "w"], [7, "u"]]),
        dict(id="bag", e=[["x"], ["y"], ["x"], ["z"]], g=[["y"], ["z"], ["y"], ["x"]]),
        dict(id="count", e=[[1], [2]], g=[[1]]),
        dict(id="few", e=[[1, 2]], g=[[1]]),
        dict(id="nogold", e=None, g=[[1]]),
        dict(id="nogen", e=[[1]], g=None),
        dict(id="empty", e=[], g=[]),
        dict(id="nulls", e=[[None]], g=[[None]]),
        dict(id="empty5", e=[], g=[[5.0]]),
        dict(id="null0", e=[[None]], g=[[0.0]]),
        dict(id="bothcut", e=[[1]], g=[[1]], e_cut=True, g_cut=True),
        dict(id="cuttotals", e=[[1]], g=[[1]], e_cut=True, g_cut=True, e_total=5000, g_total=1200),
        dict(id="onecut", e=[[1]], g=[[1]], e_cut=True),
        dict(id="setcut", e=[[1]], g=[[1]], e_cut=True, grading="set"),
        dict(id="copies", e=[[1, 1], [2, 2]], g=[[1, 1, 1], [2, 2, 2]]),
        dict(id="nullflip", e=[[None, "a", 1], ["a", None, 2]], g=[["a", None, 1], [None, "a", 2]]),
    ]
    got = run(spark, cases, allow_extra=True)
    reasons = {k: r["reason"] for k, r in got.items()}
    assert reasons == {
        "names": None, "flags": None, "pairing": "projected_rows_do_not_match",
        "bag": "expected_column_not_found_in_generated", "count": "row_count_mismatch",
        "few": "insufficient_generated_columns", "nogold": "expected_sql_execution_failed",
        "nogen": "generated_sql_execution_failed", "empty": None, "nulls": None,
        "empty5": "row_count_mismatch", "null0": "expected_column_not_found_in_generated",
        "bothcut": "results_truncated", "cuttotals": "row_count_mismatch",
        "onecut": "row_count_mismatch", "setcut": "results_truncated", "copies": None,
        "nullflip": None,
    }
    assert got["names"]["mapping"] == [1, 0]
    assert got["flags"]["mapping"] == [1, 2]
    assert got["copies"]["mapping"] == [0, 1]
    assert got["nullflip"]["mapping"] == [1, 0, 2]
    assert got["empty"]["empty_result"] and got["bothcut"]["inconclusive"]
    exact = run(spark, cases[:3], allow_extra=False)
    assert exact["flags"]["reason"] == "column_count_mismatch"


def test_gradings(spark):
    gold = [[x] for x in "abcd"]
    rows = lambda s: [[x] for x in s]
    cases = [
        dict(id="abc", e=gold, g=rows("abc"), grading="subset,=,3"),
        dict(id="dba", e=gold, g=rows("dba"), grading="subset,=,3"),
        dict(id="ab", e=gold, g=rows("ab"), grading="subset,=,3"),
        dict(id="abx", e=gold, g=rows("abx"), grading="subset,=,3"),
        dict(id="ge", e=gold, g=rows("abcd"), grading="subset,>=,3"),
        dict(id="none", e=gold, g=[], grading="subset"),
        dict(id="nogold", e=[], g=rows("a"), grading="subset"),
        dict(id="wide", e=[[1, 1, "x"], [1, 0, "y"], [0, 1, "z"]], g=[["z", 1, 0]], grading="subset"),
        dict(id="widebad", e=[[1, 1, "x"], [1, 0, "y"], [0, 1, "z"]], g=[["z", 0, 0]], grading="subset"),
        dict(id="set", e=rows("aab"), g=rows("ba"), grading="set"),
        dict(id="setbad", e=rows("aab"), g=rows("bac"), grading="set"),
        dict(id="setempty", e=[], g=[], grading="set"),
        dict(id="multiset", e=rows("aab"), g=rows("aba"), grading="multiset"),
        dict(id="list", e=rows("ab"), g=rows("ba"), grading="list"),
        dict(id="listok", e=rows("ab"), g=rows("ab"), grading="list"),
    ]
    reasons = {k: r["reason"] for k, r in run(spark, cases, allow_extra=True).items()}
    assert reasons == {
        "abc": None, "dba": None, "ab": "row_count_mismatch", "ge": None,
        "abx": "expected_column_not_found_in_generated", "none": "no_generated_rows",
        "nogold": "generated_rows_not_in_expected", "wide": None,
        "widebad": "generated_rows_not_in_expected", "set": None,
        "setbad": "row_count_mismatch", "setempty": None, "multiset": None,
        "list": "row_order_mismatch", "listok": None,
    }


def test_order_with_ties(spark):
    e = [["b", 10], ["c", 10], ["a", 5]]
    tie = [["c", 10], ["b", 10], ["a", 5]]
    cases = [
        dict(id="tie", e=e, g=tie, order=True, keys=[1]),
        dict(id="strict", e=e, g=tie, order=True),
        dict(id="same", e=e, g=[r[::-1] for r in e], order=True),
        dict(id="swapped", e=e, g=[["a", 5], ["b", 10], ["c", 10]], order=True, keys=[1]),
        dict(id="free", e=e, g=tie),
        dict(id="wrong", e=e, g=[["b", 10], ["c", 10], ["a", 6]], order=True, keys=[1]),
    ]
    got = run(spark, cases)
    assert {k: r["reason"] for k, r in got.items()} == {
        "tie": None, "strict": "row_order_mismatch", "same": None,
        "swapped": "row_order_mismatch", "free": None,
        "wrong": "expected_column_not_found_in_generated",
    }
    assert got["free"]["order_matched"] is None and got["tie"]["order_matched"]


def test_tie_runs_over_small_blocks(spark):
    keys = [3, 3, 1, 1, 1, 2, None, None, 3, 3, 3, 3]
    df = spark.createDataFrame([("c", i, [k]) for i, k in enumerate(keys)],
                               "case_id string, row_id long, key array<int>")
    for block in (1, 2, 5, 100):
        got = {r["row_id"]: r["run"] for r in tie_runs(df, block).collect()}
        start, wanted = 0, {}
        for i, k in enumerate(keys):
            if i and k != keys[i - 1]:
                start = i
            wanted[i] = start
        assert got == wanted


def brute(e, g, mode):
    """All assignments tried one by one."""
    n, m = len(e[0]), len(g[0])
    for cols in itertools.permutations(range(m), n):
        proj = [tuple(r[j] for j in cols) for r in g]
        rows = [tuple(r) for r in e]
        if mode == "subset":
            if set(proj) <= set(rows):
                return True
        elif mode == "set":
            if set(proj) == set(rows) and len(set(map(tuple, g))) == len(set(rows)):
                return True
        elif Counter(proj) == Counter(rows):
            return True
    return False


def test_random_cases_against_brute_force(spark):
    """Few distinct values, so many columns look alike."""
    rnd = random.Random(7)
    cases, wanted = [], {}
    for i in range(90):
        n, m, k = rnd.randint(1, 4), 0, rnd.randint(1, 5)
        m = n + rnd.choice([0, 0, 1])
        e = [[rnd.randint(0, 1) for _ in range(n)] for _ in range(k)]
        cols = list(range(n)) + [None] * (m - n)
        rnd.shuffle(cols)
        g = [[rnd.randint(0, 1) if c is None else r[c] for c in cols] for r in e]
        rnd.shuffle(g)
        if rnd.random() < 0.5:
            r, c = rnd.randrange(k), rnd.randrange(m)
            g[r][c] = 1 - g[r][c]
            r2 = rnd.randrange(k)
            g[r2][c] = 1 - g[r2][c]
        mode = rnd.choice(["default", "default", "set", "subset"])
        if mode == "subset":
            g = g[: rnd.randint(1, k)]
        cases.append(dict(id=str(i), e=e, g=g, grading=mode if mode != "default" else None))
        wanted[str(i)] = brute(e, g, mode)
    got = run(spark, cases, allow_extra=True)
    assert {k: r["matched"] for k, r in got.items()} == wanted
    by_id = {c["id"]: c for c in cases}
    for k, r in got.items():
        if r["matched"] and r["mapping"]:
            c = by_id[k]
            proj = [tuple(x[j] for j in r["mapping"]) for x in c["g"]]
            rows = [tuple(x) for x in c["e"]]
            if c["grading"] == "subset":
                assert set(proj) <= set(rows)
            elif c["grading"] == "set":
                assert set(proj) == set(rows)
            else:
                assert Counter(proj) == Counter(rows)


def test_twelve_equal_flags(spark):
    """Columns that hold the same values as often: only their pairs say which is which."""
    rnd = random.Random(11)
    half = [1] * 40 + [0] * 40
    columns = [rnd.sample(half, 80) for _ in range(12)]
    e = [list(r) for r in zip(*columns)]
    order = rnd.sample(range(12), 12)
    g = [[r[j] for j in order] for r in rnd.sample(e, 80)]
    wrong = [list(r) for r in g]
    i, j = (next(k for k in range(80) if wrong[k][3] == v) for v in (0, 1))
    wrong[i][3], wrong[j][3] = 1, 0
    cases = [dict(id="right", e=e, g=g), dict(id="wrong", e=e, g=wrong)]
    few = [r[:4] for r in e[:9]]
    cases += [dict(id="some", e=few, g=[r[::-1] for r in few[:5]], grading="subset"), dict(id="none", e=few, g=[[1 - c for c in r] for r in few], grading="subset")]
    got = run(spark, cases)
    assert {k: (r["matched"], r["reason"]) for k, r in got.items()} == {
        "right": (True, None), "wrong": (False, "projected_rows_do_not_match"), "some": (True, None),
        "none": (brute(few, cases[3]["g"], "subset"), None if brute(few, cases[3]["g"], "subset") else "generated_rows_not_in_expected"),
    }
    assert got["right"]["mapping"] == [order.index(c) for c in range(12)]


def test_pairs_agree_and_rows_do_not(spark):
    """Three flags of which any two are independent on both sides; in one result the third is their sum."""
    bits = list(itertools.product([0, 1], repeat=3))
    even = [b for b in bits if sum(b) % 2 == 0]
    odd = [b for b in bits if sum(b) % 2]
    rows = lambda parts: [list(p) for p in parts]
    same = [[*b, c] for b in even for c in (0, 1)]
    cases = [
        dict(id="parity", e=rows(even), g=rows(odd)),
        dict(id="even", e=rows(even), g=rows(even[::-1])),
        dict(id="free", e=rows(even * 2), g=rows(bits)),
        dict(id="moved", e=same, g=[[r[3], *r[:3]] for r in same]),
        dict(id="last", e=same, g=[[r[1], r[0], r[3], r[2]] for r in same]),
    ]
    got = run(spark, cases)
    assert {k: r["matched"] for k, r in got.items()} == {c["id"]: brute(c["e"], c["g"], "default") for c in cases}
    assert not got["parity"]["matched"] and got["moved"]["matched"]


def test_a_million_rows(spark):
    """One large case takes the same way: no group holds its rows."""
    n = 1_000_000
    base = spark.range(n).select("id", *[(F.pmod(F.xxhash64(F.col("id") % (n // 2), F.lit(k)), F.lit(2)) == (F.col("id") < n / 2).cast("int")).cast("string").alias(f"c{k}") for k in range(4)])
    side = lambda s, cols: base.select(F.lit("big").alias("case_id"), F.lit(s).alias("side"), F.col("id").alias("row_id"), F.array(*cols).alias("vals"))
    rows = side("e", ["c0", "c1", "c2", "c3"]).unionByName(side("g", ["c2", "c0", "c3", "c1"]))
    options = value_classes(fingerprints(rows)).select("case_id", options_of(F.col("classes")).alias("options"))
    assert options.first()["options"][0]["n"] == 4
    found = search(rows.withColumn("bucket", F.lit(None).cast("long")), options).collect()
    assert [(r["case_id"], r["mapping"]) for r in found] == [("big", [1, 3, 0, 2])]


def test_case_without_cells(spark):
    shapes = lambda n: dict(e_cols=n, g_cols=n)
    cases = [dict(id="bare", e=[[], []], g=[[], []], **shapes(0)), dict(id="kept", e=[["a"]], g=[["a"]])]
    cases_df, rows_df = pairs(spark, cases + [dict(id="lost", e=[["a"]], g=[["a"]])])
    got = {r["case_id"]: r for r in compare(cases_df, rows_df.filter("case_id <> 'lost'")).collect()}
    assert {k: (r["matched"], r["reason"]) for k, r in got.items()} == {
        "bare": (True, None), "kept": (True, None), "lost": (False, "expected_column_not_found_in_generated"),
    }


def test_subset_grading_reads_the_rows_once(spark):
    cases, rows = pairs(spark, [
        dict(id=f"c{i}", e=[[1, "x"], [2, "y"], [2, "y"]], g=[["y", 2]] if i % 2 else [["y", 3]], grading="subset") for i in range(20)
    ])
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(side):
        read.add(1)
        return side

    rows = rows.withColumn("side", seen.asNondeterministic()("side"))
    got = {r.case_id: r.matched for r in compare(cases, rows, modes=("subset",)).collect()}
    assert got == {f"c{i}": i % 2 == 1 for i in range(20)}
    assert read.value == 80


def test_more_cells_are_put_together_by_more_tasks(spark, monkeypatch):
    from tallygrade.operators import compare as C

    cases = [dict(id=f"c{i}", e=[[i, "x"], [2, "y"], [3, "z"]], g=[["x", i], ["y", 2], ["z", 3 + i % 2]], order=i % 3 == 0) for i in range(60)]
    whole = run(spark, cases)
    tasks, plain = [], C.match_rows

    def seen(rows, **kw):
        tasks.append(rows.rdd.getNumPartitions())
        return plain(rows, **kw)

    monkeypatch.setattr(C, "match_rows", seen)
    monkeypatch.setattr(C, "CELLS", 12)  # a case
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(spark, cases) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tasks[0] == 60
    monkeypatch.setattr(C, "CELLS", 11)  # less than a case: nothing is brought together
    assert run(spark, cases) == whole

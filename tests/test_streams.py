"""Streams of several micro-batches against the same functions on a batch, whatever order rows come in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrade.operators.outcomes import result
from tallygrade.plans.evaluators import Evaluators
from tallygrade.streaming import live

START = dt.datetime(2030, 5, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows as a stream, one file per micro-batch, and the log that it leaves."""

    def run(batches, kinds, build, name="s"):
        source = str(tmp_path / name)
        for rows in batches:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
            query = None
            stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
            log = build(stream)
            query = live.continue_load(log, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        return spark.read.schema(log.schema).parquet(str(tmp_path / f"{name}-out")), query

    return run


FAILURES = "question_id string, stage string, error string, ts timestamp, seq long, stop boolean"


def test_retries_and_stops(spark, streamed):
    rows = [
        ("early", "agent", None, at(1), 1, True), ("early", "agent", "e1", at(2), 2, False),
        ("waits", "agent", "e1", at(0), 1, False), ("waits", None, None, at(5), 2, True), ("waits", "judge", "e2", at(9), 3, False),
        ("after", "agent", "e1", at(0), 1, False), ("after", None, None, at(500), 2, True),
        ("gone", "agent", "a", at(0), 1, False), ("gone", "agent", "b", at(30), 2, False), ("gone", "agent", "c", at(90), 3, False), ("gone", None, None, at(95), 4, True),
        ("two", "agent", "a", at(0), 1, False), ("two", "judge", "b", at(3), 2, False), ("two", None, None, at(25), 3, True),
        ("only", None, None, at(3), 1, True),
    ]
    want = {
        ("early", "agent"): (1, "retry", at(22)), ("waits", "agent"): (1, "stopped", None), ("waits", "judge"): (1, "stopped", None),
        ("after", "agent"): (1, "retry", at(20)), ("gone", "agent"): (3, "exhausted", None),
        ("two", "agent"): (1, "retry", at(20)), ("two", "judge"): (1, "retry", at(23)),
    }
    told = lambda df: {(r.question_id, r.stage): (r.failures, r.outcome, r.retry_at) for r in df.collect()}
    assert told(live.retry_plan(spark.createDataFrame(rows, FAILURES), max_retries=2)) == want
    random.Random(2).shuffle(rows)
    log, _ = streamed([rows[:6], rows[6:7], rows[7:]], FAILURES, lambda s: live.retry_log(s, max_retries=2))
    assert told(live.retries_of(log, 2)) == want


def test_random_retries(spark, streamed):
    rnd = random.Random(4)
    rows = [(rnd.choice("abcdef"), rnd.choice(["x", "y"]), f"e{i}", at(rnd.randrange(200)), i, rnd.random() < 0.3) for i in range(80)]
    batch = live.retry_plan(spark.createDataFrame(rows, FAILURES), max_retries=3)
    rnd.shuffle(rows)
    log, _ = streamed([rows[:30], rows[30:50], rows[50:]], FAILURES, lambda s: live.retry_log(s, max_retries=3))
    assert sorted(map(tuple, live.retries_of(log, 3).collect())) == sorted(map(tuple, batch.collect()))


def test_waits_out_of_order(spark, streamed):
    kinds = "question_id string, event string, stage string, retry int, error string, ts timestamp, seq long"
    rnd = random.Random(9)
    rows = [(rnd.choice("abcdefgh"), rnd.choice(["wait_start", "wait_end", "stop", "note"]), rnd.choice(["x", "y"]), i % 3, "e", at(rnd.randrange(50)), i) for i in range(60)]
    batch = live.question_waits(spark.createDataFrame(rows, kinds))
    rnd.shuffle(rows)
    log, _ = streamed([rows[:20], rows[20:25], rows[25:]], kinds, live.waits_log)
    assert sorted(map(tuple, live.newest(log, "question_id").collect())) == sorted(map(tuple, batch.collect()))


def test_finished_jobs_are_freed(spark, streamed):
    kinds = "job_id string, status string, error string, ts timestamp, seq long"
    hour = 3600
    batches = [
        [("old", "running", None, at(0), 1), ("old", "failed", "boom", at(5), 2), ("long", "running", None, at(1), 3)],
        [("new", "running", None, at(10 * hour), 4), ("late", "running", None, at(10 * hour - 60), 5)],
        [("new", "completed", None, at(20 * hour), 6)],
        [("old", "running", None, at(2), 7), ("tick", "running", None, at(21 * hour), 8)],
    ]
    log, query = streamed(batches, kinds, lambda s: live.jobs_log(s, late="10 minutes", kept_seconds=hour // 2))
    got = {r.job_id: (r.status, r.error, r.created_at, r.finished_at) for r in live.jobs_of(log).collect()}
    assert got["old"] == ("failed", "boom", at(0), at(5))
    assert got["new"] == ("completed", None, at(10 * hour), at(20 * hour))
    assert got["long"][0] == "running" and set(got) == {"old", "new", "long", "late", "tick"}
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert totals[-1] == 3  # long, late and tick: those that finished are freed


def test_done_tables_get_no_more(spark, tmp_path):
    kinds = "name string, id long"
    where = lambda n: str(tmp_path / n)

    def load(rows):
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(where("in"))
        stream = spark.readStream.schema(kinds).parquet(where("in"))
        return {r["name"]: (r["rows"], r["last"]) for r in live.load_tables(stream, where("out"), where("check"), where("done"), "name", "id").collect()}

    assert load([("a", 1), ("a", 2), ("b", 1)]) == {"a": (2, 2), "b": (1, 1)}
    progress = spark.createDataFrame([("a", 2, 2), ("b", 1, 1)], "name string, rows long, last long")
    live.mark_done(progress, spark.createDataFrame([("a", 2), ("b", 5)], "name string, total long"), where("done"), "name")
    assert load([("a", 3), ("b", 2), ("c", 7)]) == {"a": (2, 2), "b": (2, 2), "c": (1, 7)}


def test_one_bad_case_costs_one_case(spark):
    cases = spark.createDataFrame([(i, str(i) if i not in (17, 18, 60) else "x") for i in range(100)], "case_id long, v string")
    none = F.lit(None).cast("string")
    score = lambda c: result(c, "number", F.col("v").cast("int").cast("double"), F.lit(True), none)
    rows = Evaluators().add("number", score).run(cases).collect()
    assert len(rows) == 100
    assert {r.case_id for r in rows if r.error} == {17, 18, 60}
    assert all(r.score == float(r.case_id) for r in rows if not r.error)
    few = Evaluators().add("number", score).run(cases, runs=1).collect()
    assert len(few) == 100 and all(r.error for r in few)


def test_bad_cases_are_found_in_few_runs(spark):
    bad = (3, 700, 1999)
    cases = spark.createDataFrame([(i if i != 5 else None, str(i) if i not in bad else f"x{i}") for i in range(2000)] + [(700, "1"), (None, "2")], "case_id long, v string")
    none, called = F.lit(None).cast("string"), []

    def score(c):
        called.append(1)
        return result(c, "number", F.col("v").cast("int").cast("double"), F.lit(True), none)

    rows = Evaluators().add("number", score).run(cases).collect()
    assert len(rows) == 2002 and len(called) < 60
    assert sorted((r.case_id, r.score) for r in rows if r.error) == [(3, 0.0), (700, 0.0), (700, 0.0), (1999, 0.0)]
    assert all(f"'x{r.case_id}'" in r.error for r in rows if r.error)  # each has its own error
    assert sorted(r.score for r in rows if r.case_id is None) == [2.0, 5.0]


def test_many_bad_cases_need_few_jobs(spark):
    """Columns that fail are found in one run, whatever their number; what else fails still costs single cases only."""
    cases = spark.createDataFrame([(i if i != 6 else None, f"x{i}" if i % 10 == 3 else str(i)) for i in range(1500)] + [(13, "1")], "case_id long, v string")
    none, jobs = F.lit(None).cast("string"), lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    score = lambda c: result(c, "number", F.col("v").cast("int").cast("double"), F.lit(True), none)
    before = jobs()
    rows = Evaluators().add("number", score).run(cases).collect()
    assert len(rows) == 1501 and jobs() - before < 300  # one and a bit for each of the 150
    assert sorted(r.case_id for r in rows if r.error) == sorted([*range(3, 1500, 10), 13])
    assert all(r.score == float(6 if r.case_id is None else r.case_id) for r in rows if not r.error) and all(f"'x{r.case_id}'" in r.error for r in rows if r.error)

    number = F.udf(lambda v: float(int(v)), "double")  # fails in a Python worker, not in a column
    own = lambda c: result(c, "number", number("v"), F.lit(True), none)
    few = spark.createDataFrame([(i, "x" if i == 3 else str(i)) for i in range(20)], "case_id long, v string")
    rows = Evaluators().add("number", own).run(few).collect()
    assert len(rows) == 20 and [(r.case_id, "'x'" in r.error) for r in rows if r.error] == [(3, True)]


def test_keys_share_states_and_long_numbers_stay_whole(spark, streamed, monkeypatch):
    kinds = "question_id long, event string, stage string, error string, retry long, ts timestamp, seq long"
    big = 1 << 53
    rows = [(7, "wait_end", "agent", None, 1, at(0), big), (7, "note", None, None, None, at(0), None), (7, "wait_start", "agent", None, 2, at(0), big + 1)]
    rows += [(i, "wait_start", "agent", None, 1, at(i % 100), i) for i in [*range(100, 130), (1 << 60) + 1]] + [(None, "wait_start", "agent", None, 3, at(1), 1)]
    monkeypatch.setattr(live, "GROUPS", 4)
    log, query = streamed([rows], kinds, live.waits_log)
    got = {r.question_id: (r.waiting, r.retry, r.retries) for r in live.newest(log, "question_id").collect()}
    assert len(got) == 33 and got[7] == (True, 2, 1) and got[(1 << 60) + 1] == (True, 1, 1) and got[None] == (True, 3, 1)
    assert sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]) <= 4

"""Literal cases of the graded behaviour, on tiny DataFrames."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallygrade.functions import classify, figures, names, replies
from tallygrade.functions.grading import parse_grading
from tallygrade.functions.statements import BRACKET, order_keys, take_apart
from tallygrade.operators import judge, metrics, shift, sqlscore
from tallygrade.plans.evaluators import Evaluators, QuestionSource
from tallygrade.plans.runs import case_results
from tallygrade.operators.outcomes import result
from tallygrade.sources import batches, capture, lookups, tables
from tallygrade.streaming import live


def column(spark, values, expression, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names(spark):
    given = ["Total ($)", "2019 Count", "", "###", "Customer ID"]
    assert column(spark, given, names.clean_name) == ["total", "_2019_count", "column", "column", "customer_id"]
    assert column(spark, ["Car Retails__Order Details", "!"], names.kebab_name) == ["car-retails-order-details", "x"]
    assert column(spark, ["BIRD-movie platform", "movie_platform", " bird_x ", "bird", None], names.connection_key) == [
        "movie_platform", "movie_platform", "x", "bird", None]
    cols = spark.createDataFrame([("t", 0, "a b"), ("t", 1, "a_b"), ("t", 2, "a_b_2"), ("t", 3, "A B")], "tbl string, pos int, c string")
    got = tables.unique_names(cols, ["tbl"], "pos", "c", "field").orderBy("pos").collect()
    assert [r["field"] for r in got] == ["a_b", "a_b_2", "a_b_2_2", "a_b_3"]


def test_gradings(spark):
    got = column(spark, ["set", " LIST ", "subset", "subset,=,3", "subset, >= , 2", "x", None], parse_grading)
    assert [(g["mode"], g["op"], g["count"]) for g in got] == [
        ("set", None, None), ("list", None, None), ("subset", None, None), ("subset", "=", 3), ("subset", ">=", 2),
        ("default", None, None), ("default", None, None)]


def test_error_classes(spark):
    errors = ["The connection attempt failed", "statement timeout", "HTTP 503", "JDBC_ERROR: x", "column x does not exist", "error 5031", None, ""]
    assert column(spark, errors, classify.is_infrastructure_error) == [True, True, True, True, False, False, False, False]
    assert column(spark, ["function foo does not exist", "relation t does not exist", "TYPE_MISMATCH: x"], classify.is_dialect_error) == [True, False, True]
    assert column(spark, ["429", "rate-limit hit", "4290"], classify.is_rate_limit) == [True, True, False]


def test_verdicts_and_decisions(spark):
    reply = '<think>maybe {"is_false_negative": false}</think>{"is_false_negative": "true", "confidence": "85", "reasoning": "same"}'
    got = column(spark, [reply, "no json", '{"a": 1}', None], replies.parse_verdict)
    assert (got[0]["is_false_negative"], got[0]["confidence"], got[0]["reasoning"], got[0]["key_differences"]) == (True, 85, "same", [])
    assert got[1:] == [None, None, None]
    got = column(spark, ['{"requires_order": false, "reason": "x"}', "requires_order: true", "?"], replies.parse_decision)
    assert [(g["requires_order"], g["reason"]) if g else None for g in got] == [(False, "x"), (True, ""), None]


def test_answers(spark):
    nested = json.dumps({"answer": {"data": {"result": {"sql": "SELECT 7"}}}})
    too_deep = json.dumps({"answer": {"data": {"result": {"output": {"sql": "SELECT 8"}}}}})
    texts = ["SELECT 1", "Here:\n```sql\nSELECT 2\n```", json.dumps({"sql": "SELECT 3", "answer": "x"}), nested, too_deep,
             json.dumps({"data": "with a as (select 1) select * from a", "result": {"sql": "SELECT 9"}}), "sorry", None]
    got = column(spark, texts, replies.parse_answer)
    assert [g["sql"] for g in got] == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT 7", None, "SELECT 9", None, None]
    assert [g["status"] for g in got][-2:] == ["error", "error"] and got[2]["summary"] == "x"


def test_statement_scores(spark):
    gold = "SELECT a FROM t WHERE x = 1 AND y = 2 AND z = 3"
    cases = spark.createDataFrame(
        [("three", gold, "select t1.a from t as t1 where 1 = x and y = 2"),
         ("same", 'SELECT f."amount" AS v FROM sales f ORDER BY v DESC', "select sales.amount from pg.public.sales order by sales.amount desc nulls last;"),
         ("other", gold, "SELECT b FROM t"), ("cte", gold, "WITH q AS (SELECT 1) SELECT * FROM q"), ("none", gold, None)],
        "case_id string, expected_sql string, generated_sql string")
    p = sqlscore.parsed(cases)
    scores = {(r["case_id"], r["clause"]): r for r in sqlscore.clause_scores(sqlscore.clause_items(p)).collect()}
    assert scores[("three", "where")]["f1"] == 0.8 and scores[("three", "where")]["missing"] == ["3 = z"]
    means = {r["case_id"]: r for r in sqlscore.component_match(p).collect()}
    assert means["cte"]["reason"] == "not_flat" and not means["cte"]["applicable"]
    assert means["none"]["score"] == 0.0 and means["none"]["applicable"] and means["same"]["score"] == 1.0
    exact = {r["case_id"]: r["score"] for r in sqlscore.exact_match(p).collect()}
    assert exact["same"] == 1.0 and exact["other"] == 0.0


def test_order_keys(spark):
    texts = ["SELECT a, b FROM t ORDER BY 2", "SELECT a, sum(x) FROM t GROUP BY a ORDER BY sum(x) DESC, A", "SELECT * FROM t ORDER BY b",
             "SELECT a FROM t ORDER BY hidden", "SELECT a FROM t", "SELECT a, b FROM t ORDER BY 3"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = take_apart(df, "s", "p").select("i", order_keys(F.col("p"), F.array(F.lit("A"), F.lit("b"))).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [[1], [1, 0], [1], None, None, None]


def test_shift_rules(spark):
    types = ["date", "timestamp(3) with time zone", "unix_seconds", "iso_timestamp", "time(3)", "interval day", "varchar", "date_string"]
    assert [classify.kind_of_moment(t) != "none" for t in types] == [True, True, True, True, False, False, False, True]
    assert column(spark, types, classify.is_temporal_type) == [True, True, True, True, False, False, False, True]
    moved = column(spark, ["2021-05-10", "n/a", "2021-02-30"], lambda c: shift.shifted(c, "date_string", -10))
    assert moved == ["2021-04-30", "n/a", "2021-02-30"]
    assert [float(v) for v in column(spark, ["$79,353,361.53", "-$1,200.50"], shift.money_as_number)] == [79353361.53, -1200.5]
    outcomes = spark.createDataFrame(
        [("half", -1, None, True, True, None, True, False, None), ("half", -7, None, True, True, None, False, False, "row_count_mismatch"),
         ("lost", -1, None, True, False, "connection reset", False, False, "x"), ("gold", -1, None, False, True, None, False, False, "x")],
        "case_id string, offset_days int, timed_out boolean, expected_ok boolean, generated_ok boolean, generated_error string, matched boolean, inconclusive boolean, reason string")
    totals = {r["case_id"]: r["shift_score"] for r in shift.shift_totals(shift.shift_status(outcomes)).collect()}
    assert totals == {"half": 0.5, "lost": None, "gold": None}


def test_percentiles_and_composite(spark):
    rows = [("a", float(v)) for v in (100, 200, 300, 400, 500)] + [("one", 500.0)] + [("neg", -5.0), ("neg", 5.0), ("neg", 0.0)]
    df = spark.createDataFrame(rows, "run_id string, v double")
    got = {r["run_id"]: r for r in metrics.percentiles(df, ["run_id"], F.col("v"), "x").collect()}
    assert (got["a"]["x_p50"], got["a"]["x_p95"], got["a"]["x_p99"]) == (300.0, 480.0, 496.0)
    assert got["one"]["x_p99"] == 500.0 and got["neg"]["x_p50"] == 0.0
    with pytest.raises(ValueError):
        metrics.check_weights({"a": 0.5})
    averages = spark.createDataFrame(
        [("r", "execution_accuracy", 1.0, 3), ("r", "contains_accuracy", 0.5, 3), ("r", "time_shift", 0.0, 0)],
        "run_id string, evaluator string, average double, evaluated long")
    assert metrics.composite_scores(averages).collect()[0]["composite_score"] == round((0.15 + 0.2) / 0.55, 4)


def test_failure_categories(spark):
    case = dict(agent_crashed=False, timed_out=False, agent_answered=True, agent_ok=True, expected_ok=True, generated_ok=True)
    cases = {
        "agent_crash": {**case, "agent_crashed": True, "timed_out": True}, "timeout": {**case, "timed_out": True},
        "sql_execution_failure": {**case, "agent_ok": False, "generated_ok": None}, "trino_failure": {**case, "expected_ok": False},
        "validation_failure": {**case, "expected_ok": None}, "unfinished": {**case, "agent_ok": False}, "fine": case,
    }
    df = spark.createDataFrame([(n, *c.values()) for n, c in cases.items()],
                               "name string, " + ", ".join(f"{k} boolean" for k in case))
    got = {r["name"]: r["c"] for r in df.select("name", metrics.failure_category().alias("c")).collect()}
    assert got == {n: (n if n in metrics.FAILURES else "validation_failure" if n == "unfinished" else None) for n in cases}


def greedy(sizes, max_rows, max_bytes):
    """Batch numbers by a walk over the rows: brackets and separators count two bytes each."""
    out, rows, filled = [], 0, 2
    for size in sizes:
        if rows and (rows == max_rows or filled + size > max_bytes):
            rows, filled = 0, 2
        out.append((out[-1] if out else -1) + (rows == 0))
        rows, filled = rows + 1, filled + size
    return out


def test_sized_batches(spark):
    df = spark.createDataFrame([("t", i, 100) for i in range(10)], "t string, i long, size int")
    count = lambda **kw: sorted(r["count"] for r in batches.sized_batches(df, ["t"], "i", "size", **kw).groupBy("batch").count().collect())
    assert count(max_rows=100, max_bytes=302) == [1, 3, 3, 3]
    assert count(max_rows=4, max_bytes=10_000) == [2, 4, 4]
    assert count(max_rows=100, max_bytes=10) == [1] * 10


@pytest.mark.parametrize("max_rows, max_bytes, block, fan", [(3, 60, 4, 2), (5, 1000, 5, 3), (7, 90, 16, 2), (500, 2000, 1, 2)])
def test_batches_cross_blocks(spark, max_rows, max_bytes, block, fan):
    rnd, rows = random.Random(block), []
    for name, n in ((None, 61), ("one", 1), ("even", 64), ("long", 1203)):
        rows += [(name, i, rnd.choice([1, 10, 30, 59, 200]), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "t string, i long, size int, batch_name string").repartition(5)
    got = {(r.t, r.i): r.batch for r in batches.sized_batches(df, ["t"], "i", "size", max_rows, max_bytes, block, fan).collect()}
    assert len(got) == len(rows)
    for name in (None, "one", "even", "long"):
        sizes = [r[2] for r in rows if r[0] == name]
        assert [got[name, i] for i in range(len(sizes))] == greedy(sizes, max_rows, max_bytes)
    empty = df.where("false")
    assert batches.sized_batches(empty, ["t"], "i", "size", max_rows, max_bytes, block, fan).collect() == []


def test_lookup_conflict_and_text_dates(spark):
    entries = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, value string")
    assert [r["key"] for r in lookups.conflicting_keys(entries).collect()] == ["a"]
    with pytest.raises(Exception, match="two different values"):
        lookups.settled_lookup(entries).collect()


def test_capture(spark):
    rows, shape = capture.capture(spark, lambda s: s.range(8).orderBy(F.desc("id")), "c", "e", max_rows=5, count_cut=True)
    s = shape.collect()[0]
    assert (s["ok"], s["n_rows"], s["cut"], s["total"]) == (True, 5, True, 8)
    assert [r["vals"][0] for r in rows.orderBy("row_id").collect()] == ["n:7.0", "n:6.0", "n:5.0", "n:4.0", "n:3.0"]
    _, bad = capture.capture(spark, lambda s: s.sql("SELECT 1/0 AS x"), "c", "g")
    assert not bad.collect()[0]["ok"] and "DIVIDE_BY_ZERO" in bad.collect()[0]["error"]


def test_prompt_and_tables(spark):
    rows = spark.createDataFrame([("c", i, [str(i), None, "x\ny"]) for i in range(60)], "case_id string, row_id long, vals array<string>")
    shapes = spark.createDataFrame([("c", ["a", "b", "c"], 60, None, False)], "case_id string, columns array<string>, n_rows long, total long, cut boolean")
    lines = judge.result_tables(rows, shapes, ["case_id"]).collect()[0]["table"].split("\n")
    assert lines[0] == "a | b | c" and lines[1] == "0 | NULL | x y" and lines[-1] == "... 10 more rows not shown" and len(lines) == 52


def test_evaluator_errors_and_sources(spark):
    cases = spark.createDataFrame([("c", "q")], "case_id string, question string")
    fine = lambda c: result(c, "fine", F.lit(1.0), F.lit(True), F.lit(None))
    broken = lambda c: c.select("missing")
    rows = {r["evaluator"]: r for r in Evaluators().add("fine", fine).add("broken", broken).run(cases).collect()}
    assert rows["fine"]["passed"] and rows["broken"]["score"] == 0.0 and rows["broken"]["error"] and rows["broken"]["applicable"]
    with pytest.raises(ValueError):
        Evaluators().run(cases)
    source = QuestionSource("bird", "bird-", lambda s, p: s.range(1), str)
    assert source.owns("BIRD-x") and not source.owns("x") and source.part("bird-X ") == "x"
    ran = cases.withColumns({c: F.lit(True) for c in ("agent_ok", "expected_ok", "generated_ok")}).withColumns(
        {"error": F.lit(""), "expected_error": F.lit(None).cast("string")})
    got = case_results(ran, Evaluators().add("fine", fine).run(cases)).collect()[0]
    assert got["succeeded"] and got["scores"] == {"fine": 1.0} and got["error"] is None


def test_waits_stop_rules(spark):
    events = [("q1", "wait_start", 1), ("q1", "stop", 2), ("q2", "stop", 1), ("q2", "wait_start", 2), ("q3", "wait_start", 1), ("q3", "wait_end", 2)]
    df = spark.createDataFrame([(q, e, "agent", 1, "429", s, s) for q, e, s in events],
                               "question_id string, event string, stage string, retry int, error string, t long, seq long")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r["question_id"]: (r["waiting"], r["stopped"], r["stop_refused"]) for r in live.question_waits(df).collect()}
    assert got == {"q1": (False, True, False), "q2": (True, False, True), "q3": (False, False, False)}
    assert column(spark, [1, 2, 3], figures.retry_delay, "int") == [20.0, 40.0, 80.0]


def test_a_bad_row_ends_one_case_only(spark):
    cases = spark.createDataFrame([(1, "7"), (2, "seven"), (3, None)], "case_id long, said string")
    given = lambda name, score: lambda df: result(df, F.lit(name), score, F.lit(True), F.lit(None), F.lit(None).cast("string"))
    both = Evaluators().add("strict", given("strict", F.col("said").cast("double"))).add("calm", given("calm", F.lit(1.0)))
    rows = {(r["evaluator"], r["case_id"]): r for r in both.run(cases).collect()}
    assert {k: r["score"] for k, r in rows.items()} == {**{("calm", i): 1.0 for i in (1, 2, 3)}, ("strict", 1): 7.0, ("strict", 2): 0.0, ("strict", 3): None}
    assert [k for k, r in rows.items() if r["error"]] == [("strict", 2)] and "seven" in rows["strict", 2]["error"]


def test_unique_names_at_size(spark):
    rnd, rows = random.Random(1), []
    for t in ("a", "b", None):
        rows += [(t, i, rnd.choice(["x", "x_2", "X 2", "x_2_2", "y", "", None, "x_3", "2"])) for i in range(400)]
    used, want = {}, {}
    for t, i, name in rows:
        taken = used.setdefault(t, set())
        base = {"X 2": "x_2", "": "column", None: "column", "2": "_2"}.get(name, name)
        field = next(f for f in itertools.chain([base], (f"{base}_{n}" for n in itertools.count(2))) if f not in taken)
        taken.add(field)
        want[t, i] = field
    got = tables.unique_names(spark.createDataFrame(rows, "t string, i int, c string").repartition(3), ["t"], "i", "c", "field").collect()
    assert {(r.t, r.i): r.field for r in got} == want and len(got) == len(rows)
    many = spark.range(100_000).select(F.lit("t").alias("t"), F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "n_2").otherwise("n").alias("c"))
    fields = tables.unique_names(many, ["t"], "i", "c", "field")
    assert fields.select("field").distinct().count() == 100_000


def test_rows_behind_a_bound(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(F.when(F.col("id") % 5 == 4, None).otherwise(F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("t"), "id")
    df.repartitionByRange(10, "id").write.parquet(path)
    stored = spark.read.parquet(path)
    state = spark.createDataFrame([("t0", 900, False), ("t1", 5, True), ("t2", None, False), (None, 990, False)], "t string, last long, done boolean")
    want = {(t, i) for t, i in map(tuple, df.collect()) if (t == "t0" and i > 900) or t in ("t2", "t3") or (t is None and i > 990)}
    for most in (500, 2):
        assert {tuple(r) for r in batches.rows_behind(stored, state, "t", "id", most).collect()} == want
    one = spark.createDataFrame([("t0", 900, False)], "t string, last long, done boolean")
    left = batches.rows_behind(stored.filter("t = 't0'"), one, "t", "id")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,900)" in plan[plan.index("PushedFilters"):]


def test_offsets_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "o")
    spark.range(400).select("id", F.date_add(F.lit("2031-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("2031-02-30").alias("words")).write.parquet(path)
    df = spark.read.parquet(path)
    bounds = {"day": (dt.date(2031, 3, 1), dt.date(2031, 3, 9))}
    moved = shift.exploded(df, {"day": "date", "words": "varchar"}, (-7, 3, 0), bounds)
    got = {(r.offset_days, r.id): (r.day, r.words) for r in moved.collect()}
    days = {i: dt.date(2031, 1, 1) + dt.timedelta(days=i) for i in range(400)}
    want = {(n, i): (d + dt.timedelta(days=n), "2031-02-30") for i, d in days.items() for n in (-7, 0, 3) if dt.date(2031, 3, 1) <= d + dt.timedelta(days=n) <= dt.date(2031, 3, 9)}
    assert got == want
    plan = shift.all_offsets({"o": df}, {"o": {"day": "date"}}, lambda t: t["o"].groupBy("offset_days").count(), bounds={"o": bounds})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(day,2031-03-02)" in pushed and "LessThanOrEqual(day,2031-05-08)" in pushed


def test_shared_folder_without_the_setting(spark, monkeypatch):
    from tallygrade import session

    class Bare:
        sparkContext, conf = spark.sparkContext, type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    folder = session.shared_folder(Bare)
    assert folder == session.shared_folder(Bare) and spark.range(3).write.parquet(f"{folder}/t") is None


def test_brackets_of_a_level_are_looked_for_once(spark):
    df = spark.createDataFrame([("select f(g(a)) from t where (b in (1, 2)) and c = 3",), ("select a from t",), (None,)], "s string")
    taken = take_apart(df, "s", "p")
    assert taken._jdf.queryExecution().optimizedPlan().toString().count(f", {BRACKET}, 0)") == 6
    got = taken.select("p.flat", "p.where", F.size("p.pieces").alias("n"), "p.depth").collect()
    assert [tuple(r) for r in got] == [(True, "‹b1› and c = 3", 4, 3), (True, "", 0, 1), (False, "", 0, 1)]

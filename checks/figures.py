"""Run statistics: events as the cases of ten runs, labels as evaluator results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.functions.figures import case_error, rate, rate_limit_label, retry_delay, seconds
from tallygrade.operators import metrics as M
from tallygrade.operators.outcomes import RESULT, result
from tallygrade.plans import reports, runs
from tallygrade.plans.evaluators import Evaluators, Metrics


def run_cases(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select("event_id", "user_id", "event_type", "value", k.alias("k"))
    kind, k, v = F.col("event_type"), F.col("k"), F.col("value")
    return e.select(
        F.col("event_id").alias("case_id"),
        (F.col("user_id") % 10).alias("run_id"),
        ((kind != "error") | (k % 2 == 0)).alias("agent_answered"),
        kind.isin("purchase", "click", "view").alias("agent_ok"),
        ((kind == "error") & (k % 2 == 1)).alias("agent_crashed"),
        ((kind == "signup") & (k % 5 == 0)).alias("timed_out"),
        F.when(k % 11 == 0, False).when(k % 11 != 1, True).alias("expected_ok"),
        F.when(k % 7 == 0, False).when(k % 7 != 1, True).alias("generated_ok"),
        v.alias("generated_exec_ms"),
        F.when(k % 3 != 0, F.lit("select 1")).alias("generated_sql"),
        (v * 10).alias("agent_latency_ms"),
        (v * 20).alias("total_latency_ms"),
        F.when(k % 4 == 0, v * 2).alias("total_execution_time_ms"),
        F.when(k % 4 == 1, v / 2).alias("time_to_first_row_ms"),
        F.when(k % 9 != 0, (k * 10).cast("long")).alias("token_usage"),
        F.when(k % 10 != 9, k % 5).alias("iterations"),
        F.when(k % 6 == 0, F.concat(F.lit("error "), k.cast("string"))).alias("error"),
        F.when(k % 11 == 0, F.lit("no such table")).alias("expected_error"),
    )


CASES = """cases AS (
  SELECT event_id AS case_id, user_id % 10 AS run_id, value AS v, k, event_type AS kind,
    event_type <> 'error' OR k % 2 = 0 AS answered, event_type IN ('purchase', 'click', 'view') AS aok,
    event_type = 'error' AND k % 2 = 1 AS crashed, event_type = 'signup' AND k % 5 = 0 AS late,
    CASE WHEN k % 11 = 0 THEN false WHEN k % 11 <> 1 THEN true END AS eok,
    CASE WHEN k % 7 = 0 THEN false WHEN k % 7 <> 1 THEN true END AS gok,
    CASE WHEN k % 3 <> 0 THEN 'select 1' END AS gsql
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)),
good AS (SELECT *, aok AND coalesce(eok, false) AND coalesce(gok, false) AS ok FROM cases)"""

CATEGORY = """CASE WHEN crashed THEN 'agent_crash' WHEN late THEN 'timeout'
   WHEN NOT answered OR (NOT aok AND NOT coalesce(gok, false)) THEN 'sql_execution_failure'
   WHEN coalesce(NOT eok, false) OR coalesce(NOT gok, false) THEN 'trino_failure'
   WHEN NOT ok THEN 'validation_failure' END"""


@check(
    "run_id bigint, total_cases bigint, passed bigint, failed bigint, failure_rate double",
    f"""WITH {CASES} SELECT run_id, count(*) AS total_cases, count_if(ok) AS passed, count_if(NOT ok) AS failed,
    round(count_if(NOT ok) / count(*), 4) AS failure_rate FROM good GROUP BY run_id""",
)
def case_counts(t: Tables) -> DataFrame:
    """Cases that ran, cases that did not, per run."""
    return run_cases(t).groupBy("run_id").agg(*M.case_counts())


@check("case_id bigint, ok boolean", f"WITH {CASES} SELECT case_id, ok FROM good")
def case_succeeded(t: Tables) -> DataFrame:
    """The agent finished and both queries ran."""
    return run_cases(t).select("case_id", M.succeeded().alias("ok"))


def exact(value: str, digits: int = 2) -> str:
    """SQL: a double rounded by its own value, not by its shortest text."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def latency_sql(v: str, where: str = "true") -> str:
    cuts = ", ".join(f"{exact(f'quantile_cont({v}, {q}) FILTER ({where})')} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    bounds = ", ".join(f"{exact(f'{f}({v}) FILTER ({where})')} AS {n}" for n, f in (("average", "avg"), ("minimum", "min"), ("maximum", "max")))
    return f"{cuts}, {bounds}, count({v}) FILTER ({where}) AS samples"


LATENCY = "run_id bigint, p50 double, p95 double, p99 double, average double, minimum double, maximum double, samples bigint"


def latency(cases: DataFrame, column: str, where=None) -> DataFrame:
    bounds = cases.groupBy("run_id").agg(*M.latency_bounds(F.col(column), "x", where))
    shown = cases if where is None else cases.filter(where)
    cuts = M.percentiles(shown, ["run_id"], F.col(column), "x")
    joined = bounds.join(cuts, "run_id", "left")
    return joined.toDF(*[c.removeprefix("x_") for c in joined.columns])


@check(LATENCY, f"WITH {CASES} SELECT run_id, {latency_sql('v * 20')} FROM cases GROUP BY run_id")
def latency_statistics(t: Tables) -> DataFrame:
    """Percentiles, mean and bounds of the total latency per run."""
    return latency(run_cases(t), "total_latency_ms")


@check(LATENCY, f"WITH {CASES} SELECT run_id, {latency_sql('v * 10', 'gsql IS NOT NULL')} FROM cases GROUP BY run_id")
def agent_latency_statistics(t: Tables) -> DataFrame:
    """The same for the agent, on cases that have SQL."""
    return latency(run_cases(t), "agent_latency_ms", M.has_sql())


@check("case_id bigint, category string", f"WITH {CASES} SELECT case_id, {CATEGORY} AS category FROM good")
def failure_categories(t: Tables) -> DataFrame:
    """The first failure category that holds for each case."""
    return run_cases(t).select("case_id", M.failure_category().alias("category"))


@check(
    "run_id bigint, category string, n bigint, rate double",
    f"""WITH {CASES}, c AS (SELECT run_id, {CATEGORY} AS category FROM good),
    n AS (SELECT run_id, count(*) AS total FROM c GROUP BY run_id)
    SELECT run_id, category, count(*) AS n, round(count(*) / any_value(total), 4) AS rate
    FROM c JOIN n USING (run_id) WHERE category IS NOT NULL GROUP BY run_id, category""",
)
def failure_breakdown(t: Tables) -> DataFrame:
    """Categories that occur in a run, with count and rate."""
    return M.failure_breakdown(run_cases(t))


@check(
    "run_id bigint, average_total_execution_time_ms double, average_time_to_first_row_ms double, total_token_usage bigint, average_token_usage double",
    f"""WITH {CASES}, x AS (SELECT run_id, CASE WHEN k % 4 = 0 THEN v * 2 WHEN gok THEN v ELSE 0 END AS t,
      CASE WHEN k % 4 = 1 THEN v / 2 WHEN gok THEN v ELSE 0 END AS f, CASE WHEN k % 9 <> 0 THEN k * 10 ELSE 0 END AS tok FROM cases)
    SELECT run_id, round(avg(t), 2) AS average_total_execution_time_ms, round(avg(f), 2) AS average_time_to_first_row_ms,
      sum(tok) AS total_token_usage, round(avg(tok), 2) AS average_token_usage FROM x GROUP BY run_id""",
)
def performance_statistics(t: Tables) -> DataFrame:
    """Execution times and tokens per run."""
    return run_cases(t).groupBy("run_id").agg(*M.performance_stats())


@check(
    "run_id bigint, average_iterations double, max_iterations bigint, total_iterations bigint, distribution string",
    f"""WITH {CASES}, x AS (SELECT run_id, CASE WHEN k % 10 <> 9 THEN k % 5 ELSE 0 END AS it FROM cases),
    d AS (SELECT run_id, it, count(*) AS n FROM x GROUP BY ALL),
    s AS (SELECT run_id, string_agg(it || ':' || n, ',' ORDER BY it) AS distribution FROM d GROUP BY run_id)
    SELECT run_id, round(avg(it), 2) AS average_iterations, max(it) AS max_iterations, sum(it) AS total_iterations,
      any_value(distribution) AS distribution FROM x JOIN s USING (run_id) GROUP BY run_id""",
)
def iteration_statistics(t: Tables) -> DataFrame:
    """Iterations per run and how they are distributed."""
    cases = run_cases(t)
    text = F.array_join(
        F.transform(
            F.map_entries("iteration_distribution"),
            lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")),
        ),
        ",",
    )
    stats = cases.groupBy("run_id").agg(*M.iteration_stats())
    return stats.join(M.iteration_distribution(cases), "run_id").withColumn("distribution", text)


@check(
    "run_id bigint, total_cases bigint, slowest double, crash bigint",
    f"""WITH {CASES} SELECT run_id, count(*) AS total_cases, round(max(v * 20), 2) AS slowest, count_if(crashed) AS crash FROM good GROUP BY run_id""",
)
def metric_plug_ins(t: Tables) -> DataFrame:
    """Registered metrics computed in one groupBy."""
    metrics = Metrics().add("counts", M.case_counts).add(
        "latency", lambda: [F.round(F.max("total_latency_ms"), 2).alias("slowest")]
    ).add("crash", lambda: [F.count_if(M.yes("agent_crashed")).alias("crash")])
    return metrics.over(run_cases(t), "run_id")


# ---------------------------------------------------------------- evaluator results

def label_results(t: Tables) -> DataFrame:
    """quality and toxic of each document as two evaluators, a third from its length."""
    docs = t.documents.select(F.col("doc_id").alias("case_id"), F.col("source").alias("run_id"), "n_chars").join(
        t.labels.withColumnRenamed("doc_id", "case_id"), "case_id", "left"
    )
    known = F.col("quality").isNotNull()
    rows = F.array(
        F.struct(F.lit("contains_accuracy").alias("evaluator"), F.col("quality").cast("double").alias("s"), known.alias("a")),
        F.struct(F.lit("execution_accuracy").alias("evaluator"), (1.0 - F.col("toxic")).alias("s"), known.alias("a")),
        F.struct(F.lit("schema_validity").alias("evaluator"), (F.col("n_chars") % 101 / 100.0).alias("s"), F.lit(True).alias("a")),
        F.struct(F.lit("time_shift").alias("evaluator"), F.lit(0.5).alias("s"), F.lit(False).alias("a")),
    )
    long = docs.select("case_id", "run_id", F.inline(rows))
    scored = result(long, F.col("evaluator"), F.coalesce("s", F.lit(0.0)), F.col("a"), F.when(~F.col("a"), "unlabelled"))
    return scored.join(docs.select("case_id", "run_id"), "case_id")


LABELS = """docs AS (SELECT d.doc_id AS case_id, source AS run_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
res AS (
  SELECT case_id, run_id, 'contains_accuracy' AS evaluator, quality::DOUBLE AS s, quality IS NOT NULL AS a FROM docs
  UNION ALL SELECT case_id, run_id, 'execution_accuracy', 1.0 - toxic, quality IS NOT NULL FROM docs
  UNION ALL SELECT case_id, run_id, 'schema_validity', (n_chars % 101 / 100.0)::DOUBLE, true FROM docs
  UNION ALL SELECT case_id, run_id, 'time_shift', 0.5, false FROM docs),
av AS (SELECT run_id, evaluator, coalesce(round(avg(CASE WHEN a THEN s END), 4), 0) AS average, count_if(a) AS evaluated FROM res GROUP BY ALL)"""

WEIGHT = "CASE evaluator WHEN 'contains_accuracy' THEN 0.4 WHEN 'execution_accuracy' THEN 0.15 WHEN 'schema_validity' THEN 0.05 WHEN 'time_shift' THEN 0.25 END::DOUBLE"


@check("run_id string, evaluator string, average double, evaluated bigint", f"WITH {LABELS} SELECT * FROM av")
def evaluator_averages(t: Tables) -> DataFrame:
    """Average over applicable results, and how many there were."""
    return M.evaluator_averages(label_results(t))


@check(
    "run_id string, composite_score double",
    f"""WITH {LABELS}, p AS (SELECT run_id, max(average) FILTER (evaluator = 'execution_accuracy' AND evaluated > 0) AS x,
      max(average) FILTER (evaluator = 'contains_accuracy' AND evaluated > 0) AS c, max(average) FILTER (evaluator = 'schema_validity' AND evaluated > 0) AS s
      FROM av GROUP BY run_id)
    SELECT run_id, round((coalesce(0.15::DOUBLE * x, 0) + coalesce(0.4::DOUBLE * c, 0) + coalesce(0.05::DOUBLE * s, 0))
      / (CASE WHEN x IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.05::DOUBLE END), 4) AS composite_score
    FROM p""",
)
def composite_scores(t: Tables) -> DataFrame:
    """Weighted mean; what judged nothing drops out and the other weights grow."""
    return M.composite_scores(M.evaluator_averages(label_results(t)))


@check(
    "run_id string, weight double, within boolean",
    f"""WITH {LABELS}, w AS (SELECT run_id, evaluator, any_value({WEIGHT}) / 0.85 AS w FROM av GROUP BY ALL)
    SELECT run_id, round(sum(w), 6) AS weight, abs(sum(w) - 1) <= 0.001 AS within FROM w GROUP BY run_id""",
)
def weight_check(t: Tables) -> DataFrame:
    """Weights per run, refused unless they sum to one."""
    e = F.col("evaluator")
    weight = F.when(e == "contains_accuracy", 0.4).when(e == "execution_accuracy", 0.15).when(e == "schema_validity", 0.05).otherwise(0.25) / 0.85
    w = M.evaluator_averages(label_results(t)).select("run_id", weight.alias("w"))
    return w.groupBy("run_id").agg(F.round(M.checked_weight_sum(F.col("w")), 6).alias("weight")).withColumn(
        "within", F.abs(F.col("weight") - 1) <= 0.001
    )


@check(
    "case_id bigint, scores string, not_applicable string",
    f"""WITH {LABELS} SELECT case_id,
      coalesce(string_agg(evaluator || '=' || (s * 100)::INT, ',' ORDER BY evaluator) FILTER (a), '') AS scores,
      coalesce(string_agg(evaluator, ',' ORDER BY evaluator) FILTER (NOT a), '') AS not_applicable FROM res GROUP BY case_id""",
)
def cases_with_results(t: Tables) -> DataFrame:
    """Each case with its scores and the evaluators that could not judge it."""
    results = label_results(t)
    cases = t.documents.select(
        F.col("doc_id").alias("case_id"), F.lit(None).cast("string").alias("error"),
        *[F.lit(True).alias(c) for c in ("agent_ok", "expected_ok", "generated_ok")],
        F.lit(None).cast("string").alias("expected_error"),
    )
    out = runs.case_results(cases, results.select(*RESULT))
    shown = F.array_join(
        F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("int").cast("string"))), ","
    )
    return out.select("case_id", shown.alias("scores"), F.concat_ws(",", "not_applicable").alias("not_applicable"))


@check(
    "case_id bigint, error string",
    f"""WITH {CASES} SELECT case_id, CASE WHEN k % 6 = 0 THEN 'error ' || k WHEN NOT eok THEN 'expected_sql_execution_failed: no such table' END AS error FROM cases""",
)
def case_errors(t: Tables) -> DataFrame:
    """A case's own error, else that its gold query failed."""
    return run_cases(t).select("case_id", case_error(F.col("error"), F.col("expected_ok"), F.col("expected_error")).alias("error"))




def run_results(t: Tables) -> DataFrame:
    """Evaluator results of the event runs: one contains result per case."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select(F.col("event_id").alias("case_id"), (F.col("user_id") % 10).alias("run_id"), k.alias("k"))
    both = F.array(
        F.struct(F.lit("contains_accuracy").alias("evaluator"), (F.col("k") % 2).cast("double").alias("s"), (F.col("k") % 8 != 0).alias("a")),
        F.struct(F.lit("component_match").alias("evaluator"), (F.col("k") / 100.0).alias("s"), F.lit(True).alias("a")),
    )
    long = e.select("case_id", "run_id", F.inline(both))
    scored = result(long.drop("run_id"), F.col("evaluator"), F.col("s"), F.col("a"), F.when(~F.col("a"), "unjudged"))
    return scored.join(e.select("case_id", "run_id"), "case_id")


ROLLED = f"""WITH {CASES}, cat AS (SELECT *, {CATEGORY} AS category FROM good), x AS (
  SELECT run_id, count(*) AS total_cases, count_if(ok) AS passed, round(count(category) / count(*), 4) AS failure_rate,
    round(quantile_cont(v * 20, 0.95), 2) AS p95, round(avg(v * 10) FILTER (gsql IS NOT NULL), 2) AS aavg,
    round(quantile_cont(v * 10, 0.5) FILTER (gsql IS NOT NULL), 2) AS a50, round(quantile_cont(v * 10, 0.95) FILTER (gsql IS NOT NULL), 2) AS a95,
    round(avg(CASE WHEN k % 4 = 0 THEN v * 2 WHEN gok THEN v ELSE 0 END), 2) AS exec,
    round(avg(CASE WHEN k % 4 = 1 THEN v / 2 WHEN gok THEN v ELSE 0 END), 2) AS first,
    round(avg(CASE WHEN k % 9 <> 0 THEN k * 10 ELSE 0 END), 2) AS tok,
    round(avg(CASE WHEN k % 10 <> 9 THEN k % 5 ELSE 0 END), 2) AS it,
    round(avg(CASE WHEN k % 8 <> 0 THEN k % 2 END), 4) AS contains, round(avg(k / 100.0), 4) AS component
  FROM cat GROUP BY run_id)"""


@check(
    "run_id bigint, name string, value double",
    ROLLED + """, w AS (SELECT run_id, round((0.4 * contains + 0.1 * component) / 0.5, 4)::DOUBLE AS composite_score, 0::DOUBLE AS execution_accuracy,
      contains::DOUBLE AS contains_accuracy, 0::DOUBLE AS sql_exact_match, 0::DOUBLE AS time_shift_score, component::DOUBLE AS component_match,
      0::DOUBLE AS schema_validity, 0::DOUBLE AS dialect_validity, failure_rate::DOUBLE AS failure_rate, (passed / total_cases)::DOUBLE AS pass_rate,
      p95::DOUBLE AS p95_latency_ms, """ + exact('aavg / 1000') + """::DOUBLE AS avg_agent_sql_generation_seconds, """ + exact('a50 / 1000') + """::DOUBLE AS p50_agent_sql_generation_seconds,
      """ + exact('a95 / 1000') + """::DOUBLE AS p95_agent_sql_generation_seconds, exec::DOUBLE AS average_total_execution_time_ms,
      first::DOUBLE AS average_time_to_first_row_ms, tok::DOUBLE AS average_token_usage, it::DOUBLE AS average_iterations FROM x)
    SELECT * FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (run_id)) INTO NAME name VALUE value)""",
)
def run_summary_scores(t: Tables) -> DataFrame:
    """A run's eighteen named scores."""
    return runs.summary_scores(runs.roll_up(run_cases(t), run_results(t)))


@check(
    "run_id bigint, total_cases bigint, passed bigint, p95 double, contains double, composite double, judged bigint, distribution bigint",
    ROLLED + f""", j AS (SELECT run_id, count_if(k % 8 <> 0) AS judged, count(DISTINCT CASE WHEN k % 10 <> 9 THEN k % 5 ELSE 0 END) AS distribution FROM cases GROUP BY run_id)
    SELECT run_id, total_cases, passed, p95, contains, round((0.4 * contains + 0.1 * component) / 0.5, 4) AS composite, judged, distribution
    FROM x JOIN j USING (run_id)""",
)
def run_roll_up(t: Tables) -> DataFrame:
    """One nested row per run with all statistics."""
    nested = runs.nested_run(runs.roll_up(run_cases(t), run_results(t)))
    return nested.select(
        "run_id", "total_cases", "passed", F.col("latency.p95").alias("p95"),
        F.col("accuracy.contains_accuracy").alias("contains"), F.col("accuracy.composite_score").alias("composite"),
        F.col("accuracy.evaluated_counts")["contains_accuracy"].alias("judged"),
        F.size("iterations.iteration_distribution").alias("distribution"),
    )


@check(
    "case_id bigint, name string, value double, comment string",
    f"""WITH {CASES}, r AS (SELECT case_id, 'contains_accuracy' AS name, (k % 2)::DOUBLE AS value, k % 2 = 1 AS ok, k % 8 <> 0 AS a FROM cases
      UNION ALL SELECT case_id, 'component_match', k / 100.0, k >= 100, true FROM cases)
    SELECT case_id, name, value, 'passed=' || CASE WHEN ok THEN 'True' ELSE 'False' END AS comment FROM r WHERE a
    UNION ALL SELECT case_id, 'agent_sql_generation_seconds', {exact('v * 10 / 1000')},
      'seconds from sending the question to the agent until it returned SQL' FROM cases WHERE gsql IS NOT NULL""",
)
def score_rows(t: Tables) -> DataFrame:
    """One row per applicable score with its comment, and the agent's seconds."""
    return reports.score_rows(run_cases(t), run_results(t).select(*RESULT))


@check(
    "case_id bigint, evaluator string, score double, error string, applicable boolean",
    f"""WITH {CASES} SELECT case_id, evaluator, 0.0 AS score, 'error ' || k AS error, true AS applicable
    FROM cases, (VALUES ('contains_accuracy'), ('component_match')) AS e(evaluator) WHERE k % 6 = 0""",
)
def error_rows_for_failed_cases(t: Tables) -> DataFrame:
    """An error row of every evaluator for cases that failed as a whole."""
    registry = Evaluators().add("contains_accuracy", lambda c: c).add("component_match", lambda c: c)
    return registry.errors(run_cases(t).filter(F.col("error").isNotNull()).select("case_id", "error"))


@check(
    "evaluator string, n bigint, total double, errors bigint",
    f"""WITH {CASES} SELECT 'engine' AS evaluator, count(*) AS n, round(sum(CASE WHEN gok THEN 1 ELSE 0 END), 2) AS total, 0 AS errors FROM cases
    UNION ALL SELECT 'tokens', count(*), round(sum(CASE WHEN k % 9 <> 0 THEN (k * 10 % 3 = 0)::INT ELSE 0 END), 2), 0 FROM cases
    UNION ALL SELECT 'broken', count(*), 0.0, count(*) FROM cases
    UNION ALL SELECT 'strict', count(*), round(sum(CASE WHEN case_id % 8192 = 5 THEN 0 ELSE 1 END), 2), count_if(case_id % 8192 = 5) FROM cases""",
)
def evaluators_side_by_side(t: Tables) -> DataFrame:
    """Registered evaluators over all cases: one cannot be planned, one fails on single cases."""
    none = F.lit(None).cast("string")
    registry = (
        Evaluators()
        .add("engine", lambda c: result(c, "engine", F.when(F.col("generated_ok"), 1.0).otherwise(0.0), F.lit(True), none))
        .add("tokens", lambda c: result(c, "tokens", F.when(F.col("token_usage") % 3 == 0, 1.0).otherwise(0.0), F.lit(True), none))
        .add("broken", lambda c: result(c, "broken", F.col("no_such_column"), F.lit(True), none))
        .add("strict", lambda c: result(c, "strict", F.when(F.col("case_id") % 8192 == 5, F.raise_error(F.lit("bad cell")).cast("double")).otherwise(1.0), F.lit(True), none))
    )
    out = registry.run(run_cases(t))
    return out.groupBy("evaluator").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.count("error").alias("errors")
    )


@check(
    "case_id bigint, secs double, share double, delay double, label string",
    f"""WITH {CASES} SELECT case_id, {exact('v * 10 / 1000')} AS secs, coalesce(round(k / nullif(k % 7, 0), 4), 0) AS share, 20 * pow(2, greatest(k % 5 - 1, 0)) AS delay,
    CASE k % 3 WHEN 0 THEN 'rate_limited: agent (retries stopped by the user)'
      WHEN 1 THEN 'rate_limited: agent (still rate limited after 3 retries: ' || substr(repeat('busy ' || k || ' ', 60), 1, 200) || ')' END AS label FROM cases""",
)
def small_figures(t: Tables) -> DataFrame:
    """Seconds, rates, retry delays and rate-limit labels."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select("event_id", "value", k.alias("k"))
    k = F.col("k")
    busy = F.repeat(F.concat(F.lit("busy "), k.cast("string"), F.lit(" ")), 60)
    return e.select(
        F.col("event_id").alias("case_id"),
        seconds(F.col("value") * 10).alias("secs"),
        rate(k, k % 7).alias("share"),
        retry_delay(k % 5).alias("delay"),
        rate_limit_label(F.lit("agent"), F.when(k % 3 == 0, "stopped").when(k % 3 == 1, "exhausted"), busy).alias("label"),
    )


@check(
    "case_id bigint, kept string",
    f"""WITH {CASES} SELECT case_id, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'agent_version=v' || k END, CASE WHEN k % 3 = 0 THEN 'token_usage=' || k END) AS kept FROM cases""",
)
def chosen_metadata(t: Tables) -> DataFrame:
    """Metadata passed through: listed keys only, no NULLs, no empty lists."""
    k = F.get_json_object("props", "$.k")
    even, third = k.cast("int") % 2 == 0, k.cast("int") % 3 == 0
    meta = F.create_map(
        F.lit("agent_version"), F.when(even, F.concat(F.lit("v"), k)),
        F.lit("feature_flags"), F.lit("[]"),
        F.lit("private"), k,
        F.lit("token_usage"), F.when(third, k),
    )
    shown = F.transform(F.map_entries(reports.chosen(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.events.select(F.col("event_id").alias("case_id"), F.array_join(F.array_sort(shown), ",").alias("kept"))


@check(
    "case_id bigint, side string, shown bigint, n_rows bigint, total bigint, first_key string",
    """WITH o AS (SELECT p_size AS c, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_size) AS n FROM part)
    SELECT c AS case_id, 'e' AS side, least(any_value(n), 100) AS shown, any_value(n) AS n_rows,
      CASE WHEN any_value(n) > 100 THEN any_value(n) END AS total, min(p_partkey)::VARCHAR AS first_key FROM o GROUP BY c""",
)
def report_outputs(t: Tables) -> DataFrame:
    """A result as report JSON: its first hundred rows and how many there are."""
    from checks.tables import parts_by_size

    rows, shapes = parts_by_size(t)
    out = F.col("output")
    return reports.result_outputs(rows, shapes).select(
        "case_id", "side",
        F.size(F.from_json(F.get_json_object(out, "$.rows"), "array<array<string>>")).alias("shown"),
        F.get_json_object(out, "$.row_count").alias("n_rows"),
        F.get_json_object(out, "$.total_rows").alias("total"),
        F.get_json_object(out, "$.rows[0][0]").alias("first_key"),
    )


@check(
    "case_id bigint, generated string, other string, contains string, keys bigint, secs double, crashed string, late string, error string",
    f"""WITH {CASES} SELECT case_id, {exact('v * 10 / 1000')} AS secs, crashed::VARCHAR AS crashed, late::VARCHAR AS late, CASE WHEN k % 6 = 0 THEN 'error ' || k END AS error, gsql AS generated, CASE WHEN gsql IS NOT NULL AND k % 2 = 0 THEN 'select 2' END AS other,
    CASE WHEN k % 8 <> 0 THEN ((k % 2)::DOUBLE)::VARCHAR END AS contains, 9 AS keys FROM cases""",
)
def sample_records(t: Tables) -> DataFrame:
    """One report record per case."""
    cases = run_cases(t).withColumns(
        {
            "succeeded": M.succeeded(),
            "expected_sql": F.lit("select gold"),
            "metadata": F.create_map(F.lit("agent_version"), F.lit("v1"), F.lit("private"), F.lit("p")),
        }
    )
    k = t.events.select(F.col("event_id").alias("case_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    cases = cases.join(k, "case_id").withColumn("executed_sql", F.when(F.col("k") % 2 == 0, "select 2").otherwise(F.col("generated_sql")))
    outputs = cases.select("case_id", F.lit("g").alias("side"), F.lit("{}").alias("output"))
    record = F.col("record")
    return reports.sample_records(cases, run_results(t).select(*RESULT), outputs).select(
        "case_id",
        F.get_json_object(record, "$.generated_sql").alias("generated"),
        F.get_json_object(record, "$.executed_generated_sql").alias("other"),
        F.get_json_object(record, "$.scores.contains_accuracy").alias("contains"),
        F.size(F.from_json(F.get_json_object(record, "$.metadata"), "map<string,string>")).alias("keys"),
        F.get_json_object(record, "$.metadata.agent_sql_generation_seconds").alias("secs"),
        F.get_json_object(record, "$.metadata.agent_crashed").alias("crashed"),
        F.get_json_object(record, "$.metadata.timed_out").alias("late"),
        F.get_json_object(record, "$.metadata.error").alias("error"),
    )

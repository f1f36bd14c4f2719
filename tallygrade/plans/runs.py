"""A run from its cases and evaluator results to one row with everything in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrade.functions.figures import case_error, seconds
from tallygrade.operators import metrics as M


def case_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row per case: scores of the applicable evaluators, names of the others, error text."""
    per_case = results.groupBy("case_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("applicable"), F.struct("evaluator", "score"))))
        ).alias("scores"),
        F.array_sort(F.collect_list(F.when(~F.col("applicable"), F.col("evaluator")))).alias("not_applicable"),
    )
    return cases.join(per_case, "case_id", "left").select(
        *[c for c in ("run_id", "case_id", "question", "expected_sql", "generated_sql") if c in cases.columns],
        M.succeeded().alias("succeeded"),
        case_error(F.col("error"), F.col("expected_ok"), F.col("expected_error")).alias("error"),
        "scores",
        "not_applicable",
    )


def roll_up(cases: DataFrame, results: DataFrame, weights: dict[str, float] | None = None,
            run: str = "run_id") -> DataFrame:
    """One row per run with all statistics.

    cases: run_id and the columns of metrics.CASE_COLUMNS that are known. results:
    RESULT plus run_id. Everything is grouped by run with partial sums; the parts
    that are joined have one row per run.
    """
    cases = M.with_case_columns(cases)
    averages = M.evaluator_averages(results, run)
    return (
        M.run_statistics(cases, run)
        .join(M.wide_averages(averages, run), run, "left")
        .join(M.composite_scores(averages, weights, run), run, "left")
        .join(M.iteration_distribution(cases, run), run, "left")
        .fillna(0.0, [*M.WEIGHTS, "composite_score"])
    )


def nested_run(rolled: DataFrame, run: str = "run_id") -> DataFrame:
    """The roll-up with its figures in groups, as a response carries them."""
    lat = lambda p: F.struct(
        *[
            F.col(f"{p}_{n}").alias(n)
            for n in ("p50", "p95", "p99", "average", "minimum", "maximum", "samples")
        ]
    )
    failures = F.struct(
        "total_failures",
        F.col("total_failure_rate").alias("failure_rate"),
        *[c for name in M.FAILURES for c in (f"{name}_count", f"{name}_rate")],
    )
    return rolled.select(
        run, "total_cases", "passed", "failed", "failure_rate",
        lat("latency").alias("latency"),
        lat("agent_latency").alias("agent_latency"),
        F.struct(*M.WEIGHTS, "composite_score", "evaluated_counts").alias("accuracy"),
        failures.alias("failure_analysis"),
        F.struct("average_iterations", "max_iterations", "total_iterations", "iteration_distribution").alias("iterations"),
        F.struct(
            "average_total_execution_time_ms", "average_time_to_first_row_ms",
            "total_token_usage", "average_token_usage",
        ).alias("performance"),
    )


def summary_scores(rolled: DataFrame, run: str = "run_id") -> DataFrame:
    """The run's 18 named scores in long form: run, name, value."""
    named = {
        "composite_score": F.col("composite_score"),
        "execution_accuracy": F.col("execution_accuracy"),
        "contains_accuracy": F.col("contains_accuracy"),
        "sql_exact_match": F.col("sql_exact_match"),
        "time_shift_score": F.col("time_shift"),
        "component_match": F.col("component_match"),
        "schema_validity": F.col("schema_validity"),
        "dialect_validity": F.col("dialect_validity"),
        "failure_rate": F.col("total_failure_rate"),
        "pass_rate": F.coalesce(F.col("passed") / F.nullif("total_cases", F.lit(0)), F.lit(0.0)),
        "p95_latency_ms": F.col("latency_p95"),
        "avg_agent_sql_generation_seconds": seconds(F.col("agent_latency_average")),
        "p50_agent_sql_generation_seconds": seconds(F.col("agent_latency_p50")),
        "p95_agent_sql_generation_seconds": seconds(F.col("agent_latency_p95")),
        "average_total_execution_time_ms": F.col("average_total_execution_time_ms"),
        "average_time_to_first_row_ms": F.col("average_time_to_first_row_ms"),
        "average_token_usage": F.col("average_token_usage"),
        "average_iterations": F.col("average_iterations"),
    }
    wide = rolled.select(run, *[c.cast("double").alias(n) for n, c in named.items()])
    return wide.unpivot([run], list(named), "name", "value")

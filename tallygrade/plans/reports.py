"""Report rows: one record per case and one row per score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.functions.figures import seconds

# Rows of a result a report shows, what its metadata always holds, and what else it may carry.
REPORT_ROWS = 100
BASE_FIELDS = (
    "total_latency_ms",
    "agent_latency_ms",
    "agent_sql_generation_seconds",
    "agent_crashed",
    "timed_out",
    "error",
    "expected_row_count",
    "generated_row_count",
)
METADATA_KEYS = (
    "total_execution_time_ms",
    "generated_sql_transpiled",
    "generated_sql_raw_error",
    "expected_sql_error",
    "token_usage",
    "refiner_iteration_count",
    "model_version",
    "agent_version",
    "prompt_version",
    "feature_flags",
    "evaluation_config",
    "agent_trace_id",
    "agent_verification",
    "agent_executed",
    "agent_summary",
)


def chosen(metadata: Column, keys: tuple[str, ...] = METADATA_KEYS) -> Column:
    """Only the listed keys, without NULLs and empty lists."""
    return F.map_filter(metadata, lambda k, v: k.isin(*keys) & v.isNotNull() & (v != "[]"))


def _merged(*objects: Column) -> Column:
    """JSON objects as one, their fields in order; names do not occur twice."""
    bodies = [F.nullif(F.substring(o, F.lit(2), F.char_length(o) - 2), F.lit("")) for o in objects]
    return F.concat(F.lit("{"), F.concat_ws(",", *bodies), F.lit("}"))


def base_metadata(cases: DataFrame) -> Column:
    """JSON of BASE_FIELDS: those that the cases have, null for the others."""
    has = lambda c: F.col(c) if c in cases.columns else F.lit(None).cast("string")
    known = {c: has(c) for c in BASE_FIELDS} | {"agent_sql_generation_seconds": seconds(has("agent_latency_ms"))}
    return F.to_json(F.struct(*[c.alias(n) for n, c in known.items()]), {"ignoreNullFields": "false"})


def result_outputs(rows: DataFrame, shapes: DataFrame, most: int = REPORT_ROWS) -> DataFrame:
    """(case_id, side, output): a result as JSON with at most `most` rows and the true number.

    rows: case_id, side, row_id, vals. shapes: case_id, side, ok, columns, n_rows, cut, error.
    """
    shown = rows.filter(F.col("row_id") < most).groupBy("case_id", "side").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "vals"))).alias("_rows")
    )
    more = F.col("n_rows") > most
    body = F.struct(
        F.col("ok").alias("success"),
        "columns",
        F.transform("_rows", lambda r: r["vals"]).alias("rows"),
        F.col("n_rows").alias("row_count"),
        "error",
        F.when(F.col("cut"), True).alias("truncated_by_executor"),
        F.when(more, True).alias("truncated"),
        F.when(more, F.col("n_rows")).alias("total_rows"),
    )
    return shapes.join(shown, ["case_id", "side"], "left").select(
        "case_id", "side", F.to_json(body).alias("output")
    )


def sample_records(cases: DataFrame, results: DataFrame, outputs: DataFrame) -> DataFrame:
    """(case_id, record): SQLs, both outputs, scores, evaluations, base fields and chosen metadata as JSON.

    cases: case_id, expected_sql, generated_sql, executed_sql, succeeded, error, metadata, and of BASE_FIELDS what there is.
    """
    sides = outputs.groupBy("case_id").agg(
        F.any_value(F.when(F.col("side") == "e", F.col("output")), True).alias("expected_output"),
        F.any_value(F.when(F.col("side") == "g", F.col("output")), True).alias("generated_output"),
    )
    one = F.struct("score", "passed", "applicable", "reason", "error", "details")
    judged = results.groupBy("case_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("applicable"), F.struct("evaluator", "score"))))
        ).alias("scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("evaluator", F.to_json(one).alias("e"))))).alias("evaluations"),
    )
    other = F.when(F.col("executed_sql") != F.col("generated_sql"), F.col("executed_sql"))
    record = F.struct(
        "generated_sql", "expected_sql", "generated_output", "expected_output", "succeeded", "error",
        "scores", "evaluations", other.alias("executed_generated_sql"),
    )
    metadata = _merged(base_metadata(cases), F.to_json(F.coalesce(chosen(F.col("metadata")), F.create_map().cast("map<string,string>"))))
    return (
        cases.join(sides, "case_id", "left")
        .join(judged, "case_id", "left")
        .select("case_id", _merged(F.to_json(record), F.concat(F.lit('{"metadata":'), metadata, F.lit("}"))).alias("record"))
    )


def score_rows(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, name, value, comment) per applicable result, and the agent's seconds where it gave SQL."""
    comment = F.when(
        F.col("error").isNotNull(),
        F.substring(F.concat(F.lit("evaluator error: "), F.col("error")), 1, 500),
    ).otherwise(
        F.concat(
            F.lit("passed="),
            F.initcap(F.col("passed").cast("string")),
            F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("; reason="), F.col("reason"))).otherwise(""),
        )
    )
    scores = results.filter("applicable").select(
        "case_id", F.col("evaluator").alias("name"), F.col("score").alias("value"), comment.alias("comment")
    )
    timed = cases.filter(F.coalesce("generated_sql", F.lit("")) != "").select(
        "case_id",
        F.lit("agent_sql_generation_seconds").alias("name"),
        seconds(F.col("agent_latency_ms")).alias("value"),
        F.lit("seconds from sending the question to the agent until it returned SQL").alias("comment"),
    )
    return scores.unionByName(timed)

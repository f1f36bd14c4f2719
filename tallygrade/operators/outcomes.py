"""Evaluator results: comparison outcomes turned into scores with applicability.

Every evaluator returns the columns of RESULT, one row per case. A result that
is not applicable stays out of all averages and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ["case_id", "evaluator", "score", "passed", "applicable", "reason", "error", "details"]


def result(df: DataFrame, evaluator: Column | str, score: Column, applicable: Column,
           reason: Column, error: Column | None = None, details: Column | None = None) -> DataFrame:
    """Rows of RESULT; passed is a full score, and nothing passes that does not apply."""
    name = F.lit(evaluator) if isinstance(evaluator, str) else evaluator
    value = F.when(applicable, score).otherwise(0.0).cast("double")
    return df.select(
        "case_id",
        name.alias("evaluator"),
        value.alias("score"),
        (applicable & (value >= 1.0)).alias("passed"),
        applicable.alias("applicable"),
        reason.cast("string").alias("reason"),
        (error if error is not None else F.lit(None)).cast("string").alias("error"),
        (details if details is not None else F.lit(None).cast("map<string,string>")).alias("details"),
    )


def blank(c: str) -> Column:
    """No text: NULL or empty."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def order_policy(default_grading: Column, matched: Column, order_matched: Column,
                 decision: Column) -> Column:
    """What the row order means for a matched case, as a text; NULL where order has no say.

    Only for default grading: order_matched is NULL unless the gold query sorts,
    and the decision says whether the question asks for an order.
    """
    differs = default_grading & matched & (order_matched == F.lit(False))
    return (
        F.when(default_grading & matched & order_matched, "order matches")
        .when(differs & decision, "order differs; the question asks for an order")
        .when(differs & ~decision, "order differs; the question does not ask for an order")
        .when(differs, "order differs; not verified")
    )


def with_order_policy(compared: DataFrame, policies: DataFrame) -> DataFrame:
    """Apply the order policy to compare()'s result.

    policies: case_id, grading_mode, decision BOOLEAN (NULL: no decision). Explicit
    gradings are followed as they are; by default a wrong order fails only when the
    question asks for an order, and without a decision it passes as not verified.
    """
    df = compared.join(policies.select("case_id", "grading_mode", "decision"), "case_id")
    default = F.col("grading_mode") == "default"
    judged = (F.col("order_matched").isNotNull()) & ~F.col("empty_result")
    policy = F.when(
        judged, order_policy(default, F.col("matched"), F.col("order_matched"), F.col("decision"))
    )
    fails = F.coalesce(policy == "order differs; the question asks for an order", F.lit(False))
    reason = F.when(
        default & (F.col("reason") == "row_order_mismatch") & ~fails, F.lit(None)
    ).otherwise(F.col("reason"))
    return df.withColumn("order_policy", policy).withColumn("reason", reason).withColumn(
        "order_not_verified", F.coalesce(policy == "order differs; not verified", F.lit(False))
    )


def execution_match(cases: DataFrame, compared: DataFrame, evaluator: str) -> DataFrame:
    """Score of a result comparison.

    cases: case_id, expected_sql, generated_sql, expected, generated. Not
    applicable without a gold query, with a failed one, or when both results are
    cut; 0 without generated SQL; else whether the rows matched.
    """
    verdict = compared.select(
        "case_id", F.col("reason").alias("_reason"), "inconclusive", "empty_result", "mapping",
        *[c for c in ("order_policy", "order_not_verified") if c in compared.columns],
    )
    df = cases.join(verdict, "case_id", "left")
    no_gold = blank("expected_sql")
    gold_failed = ~F.coalesce(F.col("expected.ok"), F.lit(False))
    no_answer = blank("generated_sql") & F.col("generated").isNull()
    inconclusive = F.coalesce(F.col("inconclusive"), F.lit(False))
    reason = (
        F.when(no_gold, "no_expected_sql")
        .when(gold_failed, "expected_sql_execution_failed")
        .when(no_answer, "no_generated_sql")
        .otherwise(F.col("_reason"))
    )
    applicable = ~(no_gold | gold_failed | (~no_answer & inconclusive))
    score = F.when(~no_answer & F.col("_reason").isNull(), 1.0).otherwise(0.0)
    keep = F.create_map(
        F.lit("empty_result"), F.col("empty_result").cast("string"),
        F.lit("column_mapping"), F.concat_ws(",", "mapping"),
        *(
            [F.lit("order_policy"), F.col("order_policy")]
            if "order_policy" in verdict.columns
            else []
        ),
    )
    details = F.map_filter(keep, lambda k, v: v.isNotNull() & (v != ""))
    return result(df, evaluator, score, applicable, reason, details=details)


def dialect_validity(cases: DataFrame) -> DataFrame:
    """0 when the SQL does not parse in its dialect or the engine refused its form.

    cases: case_id, generated_sql, executed_sql, parse_error, generated_ok, generated_error.
    """
    from tallygrade.functions.classify import is_dialect_error

    refused = ~F.coalesce(F.col("generated_ok"), F.lit(True)) & is_dialect_error(
        F.col("generated_error")
    )
    error = F.when(
        F.col("parse_error").isNotNull(), F.concat(F.lit("not valid SQL: "), F.col("parse_error"))
    ).when(
        refused,
        F.concat(F.lit("rejected by the database: "), F.substring("generated_error", 1, 500)),
    )
    applicable = ~blank("generated_sql")
    details = F.create_map(
        F.lit("rewritten"), rewritten(F.col("generated_sql"), F.col("executed_sql")).cast("string")
    )
    return result(
        cases.withColumn("_error", error), "dialect_validity",
        F.when(F.col("_error").isNull(), 1.0).otherwise(0.0), applicable,
        F.when(~applicable, "no_generated_sql").otherwise(F.col("_error")), details=details,
    )


def rewritten(generated: Column, executed: Column) -> Column:
    """Was the executed SQL another than the generated one?"""
    return F.coalesce((executed != "") & (executed != generated), F.lit(False))

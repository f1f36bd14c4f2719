"""Checking gold queries: does the answer stay the same on another engine?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_checks(cases: DataFrame, compared: DataFrame) -> DataFrame:
    """One row per question: case_id, db, reason (NULL: the answer stays the same).

    cases: case_id, db, generated. A second engine that failed is an error; rows
    that differ are a different result.
    """
    judged = cases.select("case_id", "db", F.col("generated.ok").alias("ran")).join(compared, "case_id")
    reason = F.when(
        ~F.col("matched"), F.when(F.coalesce("ran", F.lit(False)), "different result").otherwise("error")
    )
    return judged.select("case_id", "db", reason.alias("reason"))


def verification_tally(checks: DataFrame) -> DataFrame:
    """Per database: questions that keep their answer, and all questions."""
    return checks.groupBy("db").agg(
        F.count_if(F.col("reason").isNull()).alias("ok"), F.count("*").alias("total")
    )


def failing_questions(checks: DataFrame) -> DataFrame:
    """The failing questions with their reasons, one row each."""
    return checks.filter(F.col("reason").isNotNull())

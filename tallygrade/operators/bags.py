"""Bag and set comparison of rows that carry a case_id and a side ('e' or 'g').

Every test is one aggregate over both sides together: no join, partial sums
before the shuffle, and the shuffle key holds the row itself, so a case with
very many rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_count(side: str) -> Column:
    return F.count_if(F.col("side") == side)


def row_counts(rows: DataFrame, row: list[str], case: str = "case_id") -> DataFrame:
    """How often each distinct row occurs on each side: `in_expected`, `in_generated`."""
    return rows.groupBy(case, *row).agg(
        side_count("e").alias("in_expected"), side_count("g").alias("in_generated")
    )


def bag_equal(rows: DataFrame, row: list[str], case: str = "case_id") -> DataFrame:
    """Per case: are the two sides the same rows, as often?"""
    per_row = row_counts(rows, row, case)
    return per_row.groupBy(case).agg(
        F.bool_and(F.col("in_expected") == F.col("in_generated")).alias("equal")
    )


def set_equal(rows: DataFrame, row: list[str], case: str = "case_id") -> DataFrame:
    """Per case: do the two sides hold the same distinct rows?"""
    per_row = row_counts(rows, row, case)
    return per_row.groupBy(case).agg(
        F.bool_and((F.col("in_expected") > 0) == (F.col("in_generated") > 0)).alias("equal")
    )


def subset_of_expected(rows: DataFrame, row: list[str], case: str = "case_id") -> DataFrame:
    """Per case: is every generated row an expected row?"""
    per_row = row_counts(rows, row, case)
    return per_row.groupBy(case).agg(
        F.bool_and((F.col("in_generated") == 0) | (F.col("in_expected") > 0)).alias("contained")
    )


def bag_difference(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key and item: how many are shared, missing from and extra in the generated side."""
    n = rows.groupBy(*keys, item).agg(side_count("e").alias("e"), side_count("g").alias("g"))
    zero = F.lit(0).cast("long")
    return n.select(
        *keys,
        item,
        F.least("e", "g").alias("shared"),
        F.greatest(F.col("e") - F.col("g"), zero).alias("missing"),
        F.greatest(F.col("g") - F.col("e"), zero).alias("extra"),
    )


def first_occurrences(rows: DataFrame, keys: list[str], row: str, position: str) -> DataFrame:
    """Distinct rows with the position where each came first."""
    return rows.groupBy(*keys, row).agg(F.min(position).alias(position))

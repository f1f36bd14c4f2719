"""Writers: kept questions, verified lists and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_status(check: Column) -> Column:
    """`ok`, `different result`, or `error` for any other text; unparsed without a check."""
    return F.when(check.isNull(), "unparsed").when(
        check.isin("ok", "different result"), check
    ).otherwise("error")


def status_counts(questions: DataFrame, status: Column) -> DataFrame:
    return questions.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def kept_questions(questions: DataFrame, only_ok: bool) -> DataFrame:
    return questions.filter(F.col("check") == "ok") if only_ok else questions


def write_questions(questions: DataFrame, path: str) -> None:
    """One JSON object per line."""
    questions.write.mode("overwrite").json(path)


def merge_verified(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved (engine, db_id, id) with the new lists in place of the old ones.

    A list is its rows: the ids of an engine and database are never collected.
    """
    kept = saved.join(new.select("engine", "db_id").distinct(), ["engine", "db_id"], "left_anti")
    return kept.unionByName(new.select(*saved.columns))


def upsert(saved: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Saved rows with the new ones by key; of two new ones the last wins."""
    from tallygrade.sources.questions import last_per_key

    last = last_per_key(new, [key], F.col(position)).drop(position)
    kept = saved.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*saved.columns))

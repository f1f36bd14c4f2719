"""Queries over the test tables, each with the SQL that checks it.

A check names its result columns with their types once; both the Spark result
and the SQL are cast to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


class Tables:
    """The test tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def check(columns: str, sql: str | None = None):
    """Register a query under its function's name. columns: `name type, ...`."""
    spec = [c.split() for c in columns.split(",")]

    def register(build: Callable[[Tables], DataFrame]):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Tables(spark, folder))
            return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in spec])

        query.__name__ = build.__name__
        query.__doc__ = build.__doc__
        QUERIES[build.__name__] = query
        if sql is not None:
            casts = ", ".join(f'CAST("{n}" AS {SQL_TYPES[t]}) AS "{n}"' for n, t in spec)
            ORACLES[build.__name__] = f"SELECT {casts} FROM ({sql}) AS answer"
        return build

    return register


def load_all() -> None:
    from checks import comparisons, figures, live, questions, replies, shifts, statements, tables, texts  # noqa: F401


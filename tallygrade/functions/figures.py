"""Small shared figures: rates, seconds, delays, labels and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrade.functions.cells import rint_product

# Connection dialect -> dialect the SQL is written in.
DIALECTS = {
    "postgresql": "postgres",
    "postgres": "postgres",
    "trino": "trino",
    "presto": "presto",
    "spark": "databricks",
    "databricks": "databricks",
    "mysql": "mysql",
    "mariadb": "mysql",
    "tsql": "tsql",
    "mssql": "tsql",
    "snowflake": "snowflake",
    "bigquery": "bigquery",
    "oracle": "oracle",
    "duckdb": "duckdb",
    "sqlite": "sqlite",
    "redshift": "redshift",
}


def rounded(value: Column, digits: int) -> Column:
    """Rounding of the double itself: 0.105 is a little less than its text says."""
    unit = float(10**digits)
    return rint_product(value.cast("double"), F.lit(unit)) / unit


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with two digits; NULL counts as 0."""
    return rounded(F.coalesce(ms.cast("double"), F.lit(0.0)) / 1000, 2)


def rate(part: Column, whole: Column) -> Column:
    """part / whole with four digits, 0 for an empty whole."""
    return F.coalesce(rounded(part / F.nullif(whole, F.lit(0)), 4), F.lit(0.0))


def retry_delay(retry: Column, base_seconds: float = 20.0) -> Column:
    """Seconds before retry number `retry`: doubling, starting from the base."""
    return F.lit(base_seconds) * F.pow(F.lit(2.0), F.greatest(retry - 1, F.lit(0)))


def rate_limit_label(stage: Column, outcome: Column, error: Column, max_retries: int = 3) -> Column:
    """Error label of a question that gave up: stopped by the user, or out of retries."""
    # The words of both labels, and 200 characters of the error.
    return F.when(
        outcome == "stopped",
        F.concat(F.lit("rate_limited: "), stage, F.lit(" (retries stopped by the user)")),
    ).when(
        outcome == "exhausted",
        F.concat(
            F.lit("rate_limited: "),
            stage,
            F.lit(f" (still rate limited after {max_retries} retries: "),
            F.substring(error, 1, 200),
            F.lit(")"),
        ),
    )


def catalog_map(text: Column) -> Column:
    """`6=a, 7=b` as MAP<STRING,STRING>; blanks around keys and values are dropped."""
    tidy = F.regexp_replace(F.trim(text), r"\s*([,=])\s*", "$1")
    return F.str_to_map(F.regexp_replace(tidy, r"^,+|,+$", ""), F.lit(","), F.lit("="))


def catalog_for(catalogs: Column, connection_id: Column, default: Column) -> Column:
    """The catalog of a connection, else the default, else NULL (not covered)."""
    return F.coalesce(
        F.try_element_at(catalogs, connection_id.cast("string")), F.nullif(default, F.lit(""))
    )


def dialect_of(name: Column) -> Column:
    """The SQL dialect of a connection's dialect name, NULL if unknown."""
    pairs = [F.lit(x) for item in DIALECTS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.coalesce(name, F.lit(""))))


def case_error(error: Column, expected_ok: Column, expected_error: Column) -> Column:
    """The case's own error, else that its gold query failed."""
    return F.coalesce(
        F.nullif(error, F.lit("")),
        F.when(
            ~expected_ok,
            F.concat(
                F.lit("expected_sql_execution_failed: "),
                F.coalesce(expected_error, F.lit("None")),
            ),
        ),
    )

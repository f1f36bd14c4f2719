"""Names of columns, tables and questions brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column) -> Column:
    """Lower case, other runs of characters to `_`; `column` if empty, no leading digit."""
    base = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return (
        F.when(base == "", "column")
        .when(base.rlike("^[0-9]"), F.concat(F.lit("_"), base))
        .otherwise(base)
    )


def kebab_name(name: Column) -> Column:
    """Lower case, other runs of characters to one hyphen; `x` if empty."""
    base = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(base == "", "x").otherwise(base)


def target_table_name(database: Column, table: Column) -> Column:
    """Kebab form of `<database>__<table>`."""
    return kebab_name(F.concat(database, F.lit("__"), table))


def question_key(question: Column) -> Column:
    """Lower case with every run of other characters as one space; NULL is the empty key."""
    text = F.lower(F.coalesce(question, F.lit("")))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def connection_key(name: Column) -> Column:
    """Connection name without its `bird` prefix, blanks and hyphens as `_`; NULL if empty."""
    base = F.regexp_replace(F.lower(F.trim(name)), r"^bird[\s_\-:]+", "")
    return F.nullif(F.regexp_replace(base, r"[\s\-]+", "_"), F.lit(""))

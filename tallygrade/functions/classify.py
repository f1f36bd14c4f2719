"""Yes/no tests on error texts and type names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip

# Fixed patterns: errors of the link to the database, not of the SQL.
INFRASTRUCTURE = (
    r"(?i)connection attempt failed|could not connect|failed to connect|connection refused"
    r"|connection reset|connection (?:was )?closed|server closed the connection"
    r"|name or service not known|temporary failure in name resolution"
    r"|statement timeout|timed out|timeout|deadline exceeded"
    r"|service unavailable|bad gateway|gateway timeout|too many requests|rate limit"
    r"|\b50[234]\b|\b429\b|JDBC_ERROR"
)
RATE_LIMIT = (
    r"(?i)\b429\b|rate[ _-]?limit|too many requests|ratelimiterror|quota exceeded"
    r"|resource[ _]exhausted"
)
DIALECT = (
    r"(?i)syntax error|syntax_error|mismatched input|extraneous input|lexical error"
    r"|parse error|function_not_found"
    r"|function .* (does not exist|not registered|not found)|unexpected parameters"
    r"|operator does not exist|no operator matches|cannot be applied to|type_mismatch"
)
NO_CONNECTION_LEFT = r"(?i)connection slots are reserved|too many connections"
NAME_TAKEN = r"(?is)→ 422.*(unique|ייחודי)"


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def is_infrastructure_error(error: Column) -> Column:
    return _matches(error, INFRASTRUCTURE)


def is_rate_limit(error: Column) -> Column:
    return _matches(error, RATE_LIMIT)


def is_dialect_error(error: Column) -> Column:
    return _matches(error, DIALECT)


def is_out_of_connections(error: Column) -> Column:
    return _matches(error, NO_CONNECTION_LEFT)


def is_name_taken(error: Column) -> Column:
    return _matches(error, NAME_TAKEN)


# How a type of a given name holds a calendar moment. The first pattern that
# occurs in the lower-case name counts; a name without any holds none.
MOMENTS = (
    (r"^date_string$", "day text"),
    (r"^timestamp_string$", "moment text"),
    (r"(unix|epoch)_millis", "milliseconds"),
    (r"unix_seconds|epoch", "seconds"),
    (r"interval|^time(?!stamp)", "none"),
    (r"unix_timestamp", "seconds"),
    (r"iso_timestamp|(date|timestamp).*varchar|varchar.*(date|timestamp)", "iso text"),
    (r"^date$", "day"),
    (r"date|timestamp", "moment"),
)


def kind_of_moment(db_type: str) -> str:
    """How a type known while the plan is built holds a moment, by MOMENTS."""
    name = db_type.strip().lower()
    return next((kind for pattern, kind in MOMENTS if re.search(pattern, name)), "none")


def is_temporal_type(db_type: Column) -> Column:
    """Types that hold a calendar moment; intervals and times of day do not."""
    name = F.lower(strip(db_type))
    kinds = F.array(*[F.when(name.rlike(pattern), F.lit(kind)) for pattern, kind in MOMENTS])
    first = F.get(F.filter(kinds, lambda k: k.isNotNull()), 0)
    return F.when(db_type.isNotNull(), F.coalesce(first, F.lit("none")) != "none")


def is_money_type(db_type: Column) -> Column:
    return F.lower(strip(F.coalesce(db_type, F.lit("")))) == "money"

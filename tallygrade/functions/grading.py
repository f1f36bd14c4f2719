"""How a question's rows are graded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip

SUBSET = r"^subset(?:\s*,\s*(>=|=)\s*,\s*(\d+))?$"


def parse_grading(value: Column) -> Column:
    """STRUCT<mode, op, count>: set, multiset, list, subset[, op, n]; anything else is default."""
    text = F.lower(strip(F.coalesce(value, F.lit(""))))
    subset = text.rlike(SUBSET)
    mode = F.when(text.isin("set", "multiset", "list"), text).when(subset, "subset")
    return F.struct(
        F.coalesce(mode, F.lit("default")).alias("mode"),
        F.when(subset, F.nullif(F.regexp_extract(text, SUBSET, 1), F.lit(""))).alias("op"),
        F.when(subset, F.regexp_extract(text, SUBSET, 2).try_cast("int")).alias("count"),
    )

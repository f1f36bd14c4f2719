"""Canonical form of one result cell.

A cell becomes one tagged string, so that numbers, texts and dates of many
results can share a column: ``n:12.5`` for anything numeric (also numeric and
money text), ``t:...`` for everything else, NULL for NULL. NULL, the empty text
and zero stay three different values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: what counts as a number or an ISO date in text.
PLAIN_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
MARKED_NUMBER = r"^([-+]?)\s*[$€£₪]?\s*([-+]?)(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?$"
ISO_MOMENT = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?"
    r"\s*(Z|[+-]\d{2}(?::?\d{2})?)?$"
)
# All characters str.strip() removes.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.trim(c, F.lit(BLANKS))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


# Splits a double into two halves whose products are exact.
SPLIT = 134217729.0


def rint_product(x: Column, unit: Column) -> Column:
    """x * unit to the nearest whole number, as if the product were exact.

    Where the rounded product lands on a half, its error tells on which side of the
    half the true product is; only a true half goes to the even neighbour. unit is a
    power of ten below 2^26.
    """
    p = x * unit
    high = x * SPLIT - (x * SPLIT - x)
    error = (high * unit - p) + (x - high) * unit
    beside = F.when(error > 0, F.floor(p) + 1).otherwise(F.floor(p)).cast("double")
    half = (F.abs(p) < 2.0**51) & (F.abs(p - F.rint(p)) == 0.5) & (error != 0)
    return F.when(half, beside).otherwise(F.rint(p))


def clean_number(v: Column, digits: int = 6) -> Column:
    """Round a double to `digits` decimals, then to 12 significant digits; -0 becomes 0.

    Whole numbers below 1e12, and anything below 1e6 once rounded, already have at
    most 12 significant digits, so most cells take one step.
    """
    v = v.cast("double")
    size = F.abs(v)
    unit = float(10**digits)
    # Past this size a double has no decimals left to round.
    fixed = F.when(size < 2.0**53 / unit, rint_product(v, F.lit(unit)) / unit).otherwise(v)
    places = F.floor(F.log10(size)).cast("int") - 11
    up, down = F.pow(F.lit(10.0), -places), F.pow(F.lit(10.0), places)
    twelve = F.when(
        places <= 0, _let(fixed, lambda x: rint_product(x, up)) / up
    ).otherwise(F.rint(v / down) * down)
    return (
        F.when(F.isnan(v) | (size == float("inf")), v)
        .when((F.rint(v) == v) & (size < 1e12), v + F.lit(0.0))
        .when(size < 10.0 ** (12 - digits), fixed + F.lit(0.0))
        .otherwise(twelve + F.lit(0.0))
    )


def parse_number(text: Column) -> Column:
    """The double in a stripped text, or NULL: plain, scientific, money or thousands."""
    marked = text.rlike("[$€£₪,]") & text.rlike(MARKED_NUMBER)
    bare = F.concat(
        F.when(text.contains("-"), "-").otherwise(""), F.regexp_replace(text, r"[-+$€£₪,\s]", "")
    )
    return F.when(text.rlike(PLAIN_NUMBER), text).when(marked, bare).try_cast("double")


def iso_moment(text: Column) -> Column:
    """``YYYY-MM-DD[ HH:MM:SS[.f]][offset]`` of an ISO text, or NULL.

    Midnight in UTC is the plain date; other offsets stay as written. Each rule is
    one replacement on `date clock|zone`, so the text is never taken apart twice.
    """
    rules = (
        (ISO_MOMENT, "$1 $2|$3"),
        (r"\|(Z|\+00(:?00)?)?$", ""),  # UTC needs no mark
        (r" (00:00(:00(\.0+)?)?)?$", ""),  # midnight
        (r"\.0+(\||$)", "$1"),  # a fraction of zero
        (r" (\d\d:\d\d)(\||$)", " $1:00$2"),
        (r" \|", " 00:00:00|"),
        (r"\|", ""),
    )
    moment = text
    for pattern, new in rules:
        moment = F.regexp_replace(moment, pattern, new)
    return F.when(text.rlike(ISO_MOMENT), moment)


def tag_number(v: Column, digits: int = 6) -> Column:
    """Tag a double; NaN is the text `nan`."""
    v = v.cast("double")
    return F.when(F.isnan(v), F.lit("t:nan")).when(
        v.isNotNull(), F.concat(F.lit("n:"), clean_number(v, digits).cast("string"))
    )


# Texts that do not begin like this are neither a number nor a date.
STARTS = r"^[-+$€£₪.\d]"


def _tag_stripped(text: Column, number: Column, digits: int) -> Column:
    return F.coalesce(
        tag_number(number, digits),
        F.concat(F.lit("t:"), F.when(text.rlike(STARTS), iso_moment(text))),
        F.concat(F.lit("t:"), F.lower(text)),
    )


def tag_text(c: Column, digits: int = 6) -> Column:
    """Tag a text: number, else ISO moment, else stripped lower case.

    For single expressions; with_cells does the same for whole tables in steps that
    stay in generated code.
    """
    return _let(
        strip(c),
        lambda text: _let(
            F.when(text.rlike(STARTS), parse_number(text)),
            lambda number: _tag_stripped(text, number, digits),
        ),
    )


def tag_timestamp(c: Column) -> Column:
    """Tag a timestamp: the date at midnight, else with seconds and any fraction."""
    text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    short = (
        F.when(text.endswith(" 00:00:00.000000"), F.substring(text, 1, 10))
        .when(text.endswith(".000000"), F.substring(text, 1, 19))
        .otherwise(text)
    )
    return F.concat(F.lit("t:"), short)


def cell(c: Column, dtype: T.DataType, digits: int = 6) -> Column:
    """Tagged canonical form of a column of the given type."""
    if isinstance(dtype, T.BooleanType):
        return tag_number(c.cast("int"), digits)
    if isinstance(dtype, T.NumericType):
        return tag_number(c, digits)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return tag_timestamp(c)
    if isinstance(dtype, T.DateType):
        return F.concat(F.lit("t:"), F.date_format(c, "yyyy-MM-dd"))
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("t:"), F.lower(F.hex(c)))
    if isinstance(dtype, T.StringType):
        return tag_text(c, digits)
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    return F.concat(F.lit("t:"), F.lower(strip(c.cast("string"))))


def with_cells(df: DataFrame, columns: Iterable[str], out: str = "vals", digits: int = 6) -> DataFrame:
    """Add `out`, the canonical row as ARRAY<STRING>: one tagged cell per column.

    Texts are stripped, then read as numbers, then tagged, each in a projection of
    its own: every pattern is tried once per cell and the plan stays small.
    """
    columns = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = {
        i: c for i, c in enumerate(columns) if isinstance(types[c], T.StringType)
    }
    if texts:
        df = df.withColumns({f"_text{i}": strip(F.col(f"`{c}`")) for i, c in texts.items()})
        df = df.withColumns(
            {
                f"_number{i}": F.when(F.col(f"_text{i}").rlike(STARTS), parse_number(F.col(f"_text{i}")))
                for i in texts
            }
        )
    tagged = [
        _tag_stripped(F.col(f"_text{i}"), F.col(f"_number{i}"), digits)
        if i in texts
        else cell(F.col(f"`{c}`"), types[c], digits)
        for i, c in enumerate(columns)
    ]
    helpers = [f"_{kind}{i}" for i in texts for kind in ("text", "number")]
    return df.withColumn(out, F.array(*tagged)).drop(*helpers)

"""Small result pairs as the DataFrames the operators take."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrade.functions.cells import cell
from tallygrade.functions.grading import parse_grading

# One field per kind of value a test may hold.
RAW = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("day", T.DateType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("bin", T.BinaryType()),
    ]
)


def raw(value):
    blank = dict.fromkeys(("s", "d", "day", "ts", "b", "bin"))
    if isinstance(value, bool):
        blank["b"] = value
    elif isinstance(value, (int, float)):
        blank["d"] = float(value)
    elif isinstance(value, dt.datetime):
        blank["ts"] = value
    elif isinstance(value, dt.date):
        blank["day"] = value
    elif isinstance(value, bytes):
        blank["bin"] = value
    elif value is not None:
        blank["s"] = value
    return tuple(blank.values())


def tagged(c):
    return F.coalesce(*[cell(c[f.name], f.dataType) for f in RAW.fields])


def pairs(spark, cases):
    """cases: dicts with id, e, g (rows) and optional widths, cut, totals, grading, order..."""
    case_rows, rows = [], []
    for c in cases:
        shapes = []
        for side in "eg":
            data = c.get(side)
            width = c.get(f"{side}_cols", len(data[0]) if data else 1)
            if data is None:
                shapes.append((False, None, None, None, None))
            else:
                shapes.append(
                    (True, width, len(data), c.get(f"{side}_cut", False), c.get(f"{side}_total"))
                )
            for i, row in enumerate(data or []):
                rows.append((c["id"], side, i, [raw(v) for v in row]))
        case_rows.append(
            (c["id"], *shapes, c.get("grading"), c.get("order"), c.get("keys"))
        )
    shape = "struct<ok:boolean,n_cols:int,n_rows:long,cut:boolean,total:long>"
    cases_df = spark.createDataFrame(
        case_rows,
        f"case_id string, expected {shape}, generated {shape}, method string, "
        "requires_order boolean, order_keys array<int>",
    ).withColumn("grading", parse_grading(F.col("method")))
    schema = T.StructType(
        [
            T.StructField("case_id", T.StringType()),
            T.StructField("side", T.StringType()),
            T.StructField("row_id", T.LongType()),
            T.StructField("vals", T.ArrayType(RAW)),
        ]
    )
    rows_df = spark.createDataFrame(rows, schema).withColumn("vals", F.transform("vals", tagged))
    return cases_df, rows_df

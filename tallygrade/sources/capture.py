"""Query results captured as rows of tagged cells and one shape row per side."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrade.functions.cells import with_cells
from tallygrade.session import cut

SHAPE = (
    "case_id string, side string, ok boolean, columns array<string>, n_cols int, n_rows long, "
    "cut boolean, total long, exec_ms double, error string"
)


def result_rows(df: DataFrame, case: Column, side: str, columns: Sequence[str],
                position: Column | None = None, digits: int = 6) -> DataFrame:
    """Rows of one side of many cases: case_id, side, row_id, vals.

    position: the place of each row in its result, where order matters.
    """
    place = (position if position is not None else F.lit(None)).cast("long")
    placed = df.withColumns({"_case": case, "_place": place})
    return with_cells(placed, columns, "_vals", digits).select(
        F.col("_case").alias("case_id"),
        F.lit(side).alias("side"),
        F.col("_place").alias("row_id"),
        F.col("_vals").alias("vals"),
    )


def shapes(rows: DataFrame, cases: DataFrame, widths: dict[str, Column | int]) -> DataFrame:
    """cases + `expected` and `generated` shapes counted from rows.

    widths: number of columns per side ('e', 'g'), known even for empty results.
    Cases without a row get n_rows 0; every result counts as run and not cut.
    """
    counts = rows.groupBy("case_id").agg(
        F.count_if(F.col("side") == "e").alias("_e"), F.count_if(F.col("side") == "g").alias("_g")
    )

    def shape(n: str, width) -> Column:
        return F.struct(
            F.lit(True).alias("ok"),
            (width if isinstance(width, Column) else F.lit(width)).cast("int").alias("n_cols"),
            F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_rows"),
            F.lit(False).alias("cut"),
            F.lit(None).cast("long").alias("total"),
        )

    return (
        cases.join(counts, "case_id", "left")
        .withColumn("expected", shape("_e", widths["e"]))
        .withColumn("generated", shape("_g", widths["g"]))
        .drop("_e", "_g")
    )


def pair_shapes(shape_rows: DataFrame) -> DataFrame:
    """One row per case from one shape row per side."""
    body = F.struct("ok", "n_cols", "n_rows", "cut", "total", "columns", "exec_ms", "error")
    return shape_rows.groupBy("case_id").agg(
        F.any_value(F.when(F.col("side") == "e", body), True).alias("expected"),
        F.any_value(F.when(F.col("side") == "g", body), True).alias("generated"),
    )


def capture(spark: SparkSession, run: Callable[[SparkSession], DataFrame], case_id: str, side: str,
            max_rows: int | None = None, count_cut: bool = False,
            digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Run one query; return (rows, shape). A failure is data, never raised.

    With max_rows, max_rows + 1 rows are asked for: one more than the cap means
    the result is cut. count_cut also counts the whole result of a cut one.
    The row position follows the query's own order.
    """
    started = time.monotonic()
    try:
        df = run(spark)
        names = df.columns
        plain = df.toDF(*[f"c{i}" for i in range(len(names))])
        limited = plain.limit(max_rows + 1) if max_rows else plain
        seen = cut(
            with_cells(limited, limited.columns, "vals", digits).select(
                F.monotonically_increasing_id().alias("_at"), "vals"
            ),
            "captured",
        )
        n = seen.count()
        cut_off = bool(max_rows) and n > max_rows
        total = plain.count() if cut_off and count_cut else None
        seen = numbered(seen, "_at")
        if max_rows:
            seen = seen.filter(F.col("row_id") < max_rows)
        rows = seen.select(
            F.lit(case_id).alias("case_id"), F.lit(side).alias("side"), "row_id", "vals"
        )
        kept = max_rows if cut_off else n
        shape = (case_id, side, True, names, len(names), kept, cut_off, total)
        error = None
    except PySparkException as failure:
        rows = spark.createDataFrame([], "case_id string, side string, row_id long, vals array<string>")
        shape = (case_id, side, False, None, None, None, False, None)
        error = str(failure)
    elapsed = round((time.monotonic() - started) * 1000, 2)
    return rows, spark.createDataFrame([(*shape, elapsed, error)], SHAPE)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """row_id 0, 1, ... in the order of a monotonic id, without moving the rows.

    A monotonic id holds its partition in the upper bits; the rows before a
    partition are counted once, on one small row per partition.
    """
    part = F.shiftright(F.col(order), 33)
    within = F.col(order).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        df.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("row_id", within + F.col("_before"))
        .drop("_part", "_before", order)
    )


def objects_in_order(columns: Column, rows: Column) -> tuple[Column, Column]:
    """Rows that came as JSON objects, put in column order; and the duplicate-name flag."""
    ordered = F.transform(
        F.from_json(rows, "array<map<string,string>>"),
        lambda row: F.transform(columns, lambda c: F.try_element_at(row, c)),
    )
    return ordered, F.size(columns) != F.size(F.array_distinct(columns))


def bare_names(width: int) -> list[str]:
    """Names of a result that came without any: c0, c1, ..."""
    return [f"c{i}" for i in range(width)]

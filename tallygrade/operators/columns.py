"""Which generated column can hold which expected column's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hash sums are kept in 20-bit pieces: exact in a BIGINT up to 8e12 rows.
PIECE_BITS = 20
MASK_COLUMNS = 62


def _pieces(h: Column) -> list[Column]:
    low = (1 << PIECE_BITS) - 1
    return [
        F.sum(F.shiftrightunsigned(h, PIECE_BITS * i).bitwiseAND(F.lit(low))) for i in range(3)
    ]


def _digest(*hashes: Column) -> Column:
    """Order-free digest of a group: sums of the pieces of each hash, as one text."""
    return F.concat_ws("/", *[p.cast("string") for h in hashes for p in _pieces(h)])


def fingerprints(rows: DataFrame, bucket: bool = False) -> DataFrame:
    """One row per (case, side, column): n, values, identity.

    `values` is equal for two columns that hold the same values as often (inside
    each bucket, if there is one). `identity` is equal for two columns of one side
    that agree in every row: the hash of the whole row stands for the row.
    """
    place = [F.col("bucket")] if bucket else []
    cells = rows.select(
        "case_id",
        "side",
        *place,
        # a hash passes over NULLs, so they get a mark (no tagged cell is empty)
        F.xxhash64(F.transform("vals", lambda v: F.coalesce(v, F.lit("")))).alias("_row"),
        # outer: the size filter an inner explode adds would compute the cells twice
        F.posexplode_outer("vals").alias("col", "v"),
    ).filter(F.col("col").isNotNull())
    once = F.xxhash64(*place, F.col("v"), F.col("v").isNull())
    twice = F.xxhash64(F.lit("second"), *place, F.col("v"), F.col("v").isNull())
    same = F.xxhash64(F.lit("row"), F.col("_row"), F.col("v"), F.col("v").isNull())
    return cells.groupBy("case_id", "side", "col").agg(
        F.count("*").alias("n"),
        _digest(once, twice).alias("values"),
        _digest(same).alias("identity"),
    )


def value_classes(prints: DataFrame) -> DataFrame:
    """One row per case: `classes`, an array of (e, g) column lists with equal values.

    Lists hold (col, identity) in column order; they are as long as the results
    are wide, never as long as the results.
    """
    entry = F.struct("col", "identity")
    classes = prints.groupBy("case_id", "values").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "e", entry))).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "g", entry))).alias("g"),
        F.max("n").alias("n"),
    )
    return (
        classes.groupBy("case_id")
        .agg(
            F.collect_list(F.when(F.size("e") > 0, F.struct("e", "g"))).alias("classes"),
            F.max("n").alias("n_rows"),
            F.sum(F.size("e") + F.size("g")).alias("n_cols"),
        )
        .withColumn("n_cells", F.col("n_rows") * F.col("n_cols"))
    )


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Report form: one row per expected column with the generated columns that fit it."""
    one = classes.select("case_id", F.explode("classes").alias("c"))
    return one.select(
        "case_id",
        F.explode("c.e.col").alias("expected_col"),
        F.col("c.g.col").alias("generated_cols"),
    )


def containing_columns(distinct_rows: DataFrame) -> DataFrame:
    """Subset mode: per (case, generated column) the expected columns that hold all its values.

    The expected columns that hold a value are one bit mask per (case, value), and
    a generated column keeps the bits all its values agree on, so no pair of
    columns is written out per value. Columns are masked in chunks of 62.
    """
    cells = distinct_rows.select("case_id", "side", F.posexplode_outer("vals").alias("col", "v"))
    cells = cells.filter(F.col("col").isNotNull()).distinct()
    chunk = F.floor(F.col("col") / MASK_COLUMNS).cast("int")
    held = (
        cells.filter(F.col("side") == "e")
        .groupBy("case_id", "v", chunk.alias("chunk"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, col % {MASK_COLUMNS})")).alias("mask"))
        .withColumn("_null", F.col("v").isNull())
        .withColumn("_v", F.coalesce("v", F.lit("")))
        .drop("v")
    )
    chunks = (
        cells.filter(F.col("side") == "e")
        .groupBy("case_id")
        .agg(F.max("col").alias("_last"))
        .select("case_id", F.explode(F.sequence(F.lit(0), chunk_of("_last"))).alias("chunk"))
    )
    asked = (
        cells.filter(F.col("side") == "g")
        .join(chunks, "case_id")
        .select(
            "case_id", "col", "chunk",
            F.col("v").isNull().alias("_null"), F.coalesce("v", F.lit("")).alias("_v"),
        )
    )
    kept = (
        asked.join(held, ["case_id", "chunk", "_v", "_null"], "left")
        .groupBy("case_id", "col", "chunk")
        .agg(F.bit_and(F.coalesce("mask", F.lit(0).cast("long"))).alias("mask"))
    )
    bits = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(MASK_COLUMNS - 1)),
            lambda b: F.when(
                F.call_function("getbit", F.col("mask"), b) == 1,
                b + F.col("chunk") * MASK_COLUMNS,
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        kept.withColumn("bits", bits)
        .groupBy("case_id", "col")
        .agg(F.array_sort(F.flatten(F.collect_list("bits"))).alias("expected_cols"))
        .withColumnRenamed("col", "generated_col")
    )


def chunk_of(col: str) -> Column:
    return F.floor(F.col(col) / MASK_COLUMNS).cast("int")

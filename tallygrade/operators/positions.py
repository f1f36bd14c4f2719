"""Row order: positions compared one by one, and runs of rows that tie on their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one case that a window may hold; longer results are cut into blocks.
BLOCK_ROWS = 65_536


def running_max(df: DataFrame, keys: list[str], position: str, value: Column, out: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Largest value up to and including each position, without one task per key.

    Positions are cut into blocks: a window inside each block, a window over the
    one-row-per-block maxima, and the larger of the two.
    """
    blocked = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(position) / block_rows)
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carried", F.max("_top").over(before))
        .drop("_top")
    )
    return (
        blocked.withColumn("_inside", F.max("_value").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.col("_inside"), F.col("_carried")))
        .drop("_value", "_block", "_inside", "_carried")
    )


def tie_runs(expected: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(case_id, row_id, run): the start of the run of equal keys each position is in.

    expected: case_id, row_id (0, 1, ...), key. The key before a position is
    fetched by an equi-join on (case_id, row_id), which spreads long results.
    """
    previous = expected.select(
        "case_id", (F.col("row_id") + 1).alias("row_id"), F.col("key").alias("_previous"),
        F.lit(True).alias("_has_previous"),
    )
    starts = expected.join(previous, ["case_id", "row_id"], "left").withColumn(
        "_start",
        F.when(
            F.col("_has_previous").isNull() | ~F.col("key").eqNullSafe(F.col("_previous")),
            F.col("row_id"),
        ),
    )
    return running_max(
        starts.select("case_id", "row_id", "_start"), ["case_id"], "row_id",
        F.col("_start"), "run", block_rows,
    ).select("case_id", "row_id", "run")


def with_order_bucket(rows: DataFrame, keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `bucket`: rows that may trade places share one.

    keys: case_id, order_keys ARRAY<INT> (NULL or empty: every position counts).
    With keys, the bucket of a position is the run of equal expected keys it falls
    in, on both sides: a generated row in a run must then be one of the expected
    rows of that run, which also makes its key right.
    """
    wanted = rows.join(keys.select("case_id", "order_keys"), "case_id")
    strict = F.coalesce(F.size("order_keys") <= 0, F.lit(True))
    by_position = wanted.filter(strict).withColumn("bucket", F.col("row_id"))
    tied = wanted.filter(~strict)
    key = F.transform("order_keys", lambda k: F.element_at("vals", k + 1))
    runs = tie_runs(
        tied.filter(F.col("side") == "e").select("case_id", "row_id", key.alias("key")), block_rows
    )
    by_run = tied.join(runs, ["case_id", "row_id"]).withColumnRenamed("run", "bucket")
    return by_position.drop("order_keys").unionByName(by_run.drop("order_keys"))


def same_positions(rows: DataFrame) -> DataFrame:
    """Per case: are the rows equal position by position?"""
    per_position = rows.groupBy("case_id", "row_id").agg(
        F.max(F.when(F.col("side") == "e", F.struct("vals"))).alias("e"),
        F.max(F.when(F.col("side") == "g", F.struct("vals"))).alias("g"),
    )
    return per_position.groupBy("case_id").agg(
        F.bool_and(F.col("e").isNotNull() & F.col("g").isNotNull() & (F.col("e") == F.col("g")))
        .alias("equal")
    )

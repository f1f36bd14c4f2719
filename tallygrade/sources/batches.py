"""Loads in batches that can be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrade.session import cut

# Limits of one request.
MAX_ROWS = 500
MAX_BYTES = 8 * 1024 * 1024
# Rows of a block, and blocks whose tables are put together in one step.
BLOCK = 1 << 16
FAN = 256
# Bounds of a resumed load that become one filter.
MAX_BOUNDS = 500


def json_bytes(*columns: str) -> Column:
    """Bytes a row takes in a JSON list: its UTF-8 length and the separator."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) + 2


def fixed_batches(df: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """Add batch 0, 1, ...: rows already numbered from 0 need no ordering to be cut."""
    return df.withColumn("batch", F.floor(F.col(position) / size))


def numbered_rows(df: DataFrame, keys: list[str], order: list[str], spread: Column,
                  out: str = "row_idx") -> DataFrame:
    """Number rows from 0 per key in the order of `order`, without one task per key.

    spread is a number that never falls along the order (a range of the first order
    column): rows are numbered inside each spread value, and the sizes of the
    values before it are added. One task sees the rows of one spread value.
    """
    ranged = df.withColumn("_range", spread)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    sizes = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_at", F.row_number().over(inside) - 1)
        .join(sizes, [*keys, "_range"])
        .withColumn(out, F.col("_at") + F.col("_before"))
        .drop("_range", "_at", "_before")
    )


def sized_batches(df: DataFrame, keys: list[str], position: str, size: str, max_rows: int = MAX_ROWS,
                  max_bytes: int = MAX_BYTES, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Add `batch` within each key: greedy, at most max_rows rows and about max_bytes; a row over the limit goes alone.

    position numbers the rows of a key from 0 without gaps. Where a batch begins depends on all rows before it, so rows
    are looked at in blocks that also see the first max_rows rows of the next one. In a block, pointers to the next
    batch are doubled until they leave it; that makes a table from each place where the first batch may begin to the place
    in the next block and the number of batches. Tables are put together `fan` at a time, level by level, and the places
    where batches do begin are handed down again. No group holds more than a block's rows or `fan` tables of max_rows
    entries, however long a table is. Null keys are one key.
    """
    block = max(block, max_rows)
    fields = [df.schema[c] for c in keys]
    of = lambda *more: T.StructType([*fields, *[T.StructField(n, k) for n, k in more]])
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    at = F.col(position).cast("long")
    here = F.floor(at / block)
    both = F.when((at % block < max_rows) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    slim = df.select(*keys, at.alias("_at"), F.col(size).cast("long").alias("_bytes"), F.explode(both).alias("_unit"))
    slim = cut(slim, "sizes")

    def pointers(pdf):
        """Own rows, rows seen, and for each own row the first row of the batch after the one that begins there."""
        import numpy as np

        first = int(pdf["_unit"].iloc[0]) * block
        pdf = pdf.sort_values("_at")
        own = int((pdf["_at"] < first + block).sum())
        filled = np.concatenate([[0], np.cumsum(pdf["_bytes"].to_numpy(dtype=np.int64))])
        row = np.arange(own)
        fits = np.searchsorted(filled, filled[:own] + max_bytes - 2, "right") - 1
        return pdf, own, len(pdf), np.maximum(row + 1, np.minimum(row + max_rows, fits))

    def named(pdf, **columns):
        import pandas as pd

        out = pd.DataFrame(columns)
        for c in keys:
            out[c] = [pdf[c].iloc[0]] * len(out)
        return out

    def table(pdf):
        import numpy as np

        pdf, own, seen, after = pointers(pdf)
        hop = np.concatenate([after, np.arange(own, seen + 1)])
        count = (np.arange(seen + 1) < own).astype(np.int64)
        while (hop[:own] < own).any():
            count, hop = count + count[hop], hop[hop]
        exits, counts = np.zeros(max_rows, np.int64), np.zeros(max_rows, np.int64)
        known = min(own, max_rows)
        exits[:known], counts[:known] = np.clip(hop[:known] - block, 0, max_rows - 1), count[:known]
        return named(pdf, _unit=[int(pdf["_unit"].iloc[0])], exits=[exits], counts=[counts])

    def together(pdf):
        import numpy as np

        pdf = pdf.sort_values("_unit")
        place, total = np.arange(max_rows), np.zeros(max_rows, np.int64)
        for exits, counts in zip(pdf["exits"], pdf["counts"]):
            total += np.asarray(counts)[place]
            place = np.asarray(exits)[place]
        return named(pdf, _unit=[int(pdf["_unit"].iloc[0]) // fan], exits=[place], counts=[total])

    def handed_down(pdf):
        pdf = pdf.sort_values("_unit")
        place, total, places, totals = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0]), [], []
        for exits, counts in zip(pdf["exits"], pdf["counts"]):
            places.append(place)
            totals.append(total)
            total += int(counts[place])
            place = int(exits[place])
        return named(pdf, _unit=pdf["_unit"].to_numpy(), entry=places, before=totals)

    def numbered(pdf):
        import numpy as np

        entry, before = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0])
        pdf, own, _, after = pointers(pdf)
        starts, at = [], entry
        while at < own:
            starts.append(at)
            at = int(after[at])
        batch = before - 1 + np.searchsorted(np.array(starts, np.int64), np.arange(own), "right")
        return named(pdf, _at=pdf["_at"].to_numpy()[:own], batch=batch)

    kind = of(("_unit", long), ("exits", longs), ("counts", longs))
    entries = of(("_unit", long), ("entry", long), ("before", long))
    levels = [cut(slim.groupBy(*keys, "_unit").applyInPandas(table, kind), "jumps")]
    top = slim.agg(F.max("_unit")).first()[0] or 0
    while top:
        upper = levels[-1].withColumn("_over", F.floor(F.col("_unit") / fan)).groupBy(*keys, "_over")
        levels.append(cut(upper.applyInPandas(together, kind), "jumps"))
        top //= fan
    zero = F.lit(0).cast("long")
    begins = levels.pop().select(*keys, "_unit", zero.alias("entry"), zero.alias("before"))
    for level in reversed(levels):
        upper = joined_on(level.withColumn("_over", F.floor(F.col("_unit") / fan)), begins.withColumnRenamed("_unit", "_over"), keys, "_over")
        begins = cut(upper.groupBy(*keys, "_over").applyInPandas(handed_down, entries), "begins")
    marked = joined_on(slim, begins, keys, "_unit").groupBy(*keys, "_unit").applyInPandas(numbered, of(("_at", long), ("batch", long)))
    return joined_on(df.withColumn("_at", at), marked, keys, "_at").drop("_at")


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Inner join on keys and more; equal nulls meet, as fields of a struct."""
    key = lambda df: F.struct(*[df[c] for c in [*keys, *more]])
    right = right.select(key(right).alias("_key"), *[c for c in right.columns if c not in (*keys, *more)])
    return left.join(right, key(left) == right["_key"]).drop("_key")


def pending_rows(df: DataFrame, state: DataFrame, key: str, row_idx: str) -> DataFrame:
    """Rows not sent yet: those from the pushed count on, of tables that are not done.

    state: key, pushed_rows, done; a table without state starts at 0.
    """
    seen = state.select(key, F.col("pushed_rows").alias("_pushed"), F.col("done").alias("_done"))
    todo = df.join(seen, key, "left")
    return todo.filter(
        ~F.coalesce("_done", F.lit(False)) & (F.col(row_idx) >= F.coalesce("_pushed", F.lit(0)))
    ).drop("_pushed", "_done")


def rows_behind(df: DataFrame, state: DataFrame, key: str, order: str, most: int = MAX_BOUNDS) -> DataFrame:
    """Rows not sent yet, by the last value of `order` that was sent of each table: no row is numbered again.

    state: key, last, done; a table without state, or with a null last, is not sent at all. Values of order are unique and
    sent in rising order. The bounds become a filter on the table's own columns, which reaches the scan, so that
    files and row groups that were sent are not read. With more than `most` tables the bounds are joined, and only
    the least of them reaches the scan.
    """
    bounds = state.select(key, "last", "done").limit(most + 1).collect()
    if len(bounds) <= most:
        after, known = F.lit(False), [r[key] for r in bounds if r[key] is not None]
        for r in bounds:
            if not r["done"]:
                of = F.col(key).isNull() if r[key] is None else F.col(key) == F.lit(r[key])
                after = after | (of & (F.lit(True) if r["last"] is None else F.col(order) > F.lit(r["last"])))
        unknown = F.col(key).isNotNull() & ~F.col(key).isin(known) if known else F.col(key).isNotNull()
        nameless = F.lit(False) if any(r[key] is None for r in bounds) else F.col(key).isNull()
        return df.filter(after | unknown | nameless)
    told = state.select(F.col(key).alias("_key"), F.col("last").alias("_last"), F.col("done").alias("_done"))
    todo = df.join(told, df[key].eqNullSafe(F.col("_key")), "left")
    return todo.filter(~F.coalesce("_done", F.lit(False)) & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))).drop("_key", "_last", "_done")


def load_progress(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Per table: total rows, rows sent, done."""
    totals = df.groupBy(key).agg(F.count("*").alias("total_rows"))
    joined = totals.join(state.select(key, "pushed_rows", "done"), key, "left")
    return joined.select(
        key,
        "total_rows",
        F.coalesce("pushed_rows", F.lit(0)).cast("long").alias("pushed_rows"),
        F.coalesce("done", F.lit(False)).alias("done"),
    )

"""Comparison of many pairs of query results in one job.

cases: one row per case
    case_id
    expected, generated   STRUCT<ok, n_cols, n_rows, cut, total> (see capture.shapes)
    grading               STRUCT<mode, op, count>  (optional column)
    requires_order        BOOLEAN                  (optional column)
    order_keys            ARRAY<INT>               (optional column)
rows: case_id, side 'e' or 'g', row_id, vals ARRAY<STRING> of tagged cells

Column names never count, and a generated column is matched to an expected one
by its data. Settled cases leave before any cell is read; the rest cost one pass
for column fingerprints and one for the row bags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.operators import mapping as M
from tallygrade.operators.columns import containing_columns, fingerprints, value_classes
from tallygrade.operators.positions import with_order_bucket
from tallygrade.session import cut

#: Cells of results that a task puts together by case; more cells make more tasks.
CELLS = 1 << 19
OUT = ["case_id", "matched", "order_matched", "reason", "inconclusive", "empty_result", "mapping"]


def _ok(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.ok"), F.lit(False))


def gate(allow_extra: bool) -> Column:
    """The first rule that settles a case before its rows are read, else NULL.

    The order of the rules is part of the result: the first that holds wins.
    """
    mode = F.col("grading.mode")
    e_cut = F.coalesce(F.col("expected.cut"), F.lit(False))
    g_cut = F.coalesce(F.col("generated.cut"), F.lit(False))
    totals_differ = F.coalesce(F.col("expected.total") != F.col("generated.total"), F.lit(False))
    g_cols, e_cols = F.col("generated.n_cols"), F.col("expected.n_cols")
    other_width = F.lit(False) if allow_extra else g_cols != e_cols
    by_count = mode.isin("default", "multiset", "list")
    return (
        F.when(~_ok("expected"), "expected_sql_execution_failed")
        .when(~_ok("generated"), "generated_sql_execution_failed")
        .when(g_cols < e_cols, "insufficient_generated_columns")
        .when(other_width, "column_count_mismatch")
        .when((e_cut | g_cut) & mode.isin("set", "subset"), "results_truncated")
        .when(e_cut & g_cut, F.when(totals_differ, "row_count_mismatch").otherwise("results_truncated"))
        .when(e_cut | g_cut, "row_count_mismatch")
        .when(
            by_count & (F.col("expected.n_rows") != F.col("generated.n_rows")), "row_count_mismatch"
        )
        .when(by_count & (F.col("expected.n_rows") == 0), "empty")
    )


def _with_defaults(cases: DataFrame) -> DataFrame:
    """Fill in the optional columns."""
    if "grading" not in cases.columns:
        cases = cases.withColumn(
            "grading",
            F.struct(
                F.lit("default").alias("mode"),
                F.lit(None).cast("string").alias("op"),
                F.lit(None).cast("int").alias("count"),
            ),
        )
    if "requires_order" not in cases.columns:
        cases = cases.withColumn("requires_order", F.lit(None).cast("boolean"))
    if "order_keys" not in cases.columns:
        cases = cases.withColumn("order_keys", F.lit(None).cast("array<int>"))
    return cases


def _cells(side: str) -> Column:
    """Cells of a case's result on one side, as its shape tells."""
    return F.coalesce(F.col(f"{side}.n_rows").cast("long") * F.greatest(F.col(f"{side}.n_cols"), F.lit(1)), F.lit(0).cast("long"))


def by_case(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows in partitions by case, as many as the cells of sizes (case_id, cells) ask for, so that a task holds no more of larger inputs.

    Few rows stay as they are, and so do those with a case that is more than a task's share: a partition by case
    would hold it whole, where joins can split it.
    """
    found = sizes.agg(F.sum("cells").alias("all"), F.max("cells").alias("most")).first()
    tasks = -(-(found["all"] or 0) // CELLS)
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) or found["most"] > CELLS:
        return rows
    return rows.repartition(tasks, "case_id")


def _direct(classes: Column) -> Column:
    """The mapping when every class is one column, or copies of one, on each side."""
    pairs = F.flatten(
        F.transform(
            classes,
            lambda c: F.transform(
                c["e"],
                lambda e, i: F.struct(e["col"].alias("e"), F.get(c["g"], i)["col"].alias("g")),
            ),
        )
    )
    return F.transform(F.array_sort(pairs), lambda p: p["g"])


def _verdict(classes: Column) -> Column:
    """What the column classes alone say: a failure, `direct`, or `search`."""
    plain = F.forall(
        classes,
        lambda c: (F.size(F.array_distinct(c["e"]["identity"])) == 1)
        & (F.size(F.array_distinct(c["g"]["identity"])) == 1),
    )
    return (
        F.when(
            F.exists(classes, lambda c: F.size(c["g"]) == 0),
            "expected_column_not_found_in_generated",
        )
        .when(
            F.exists(classes, lambda c: F.size(c["e"]) > F.size(c["g"])),
            "projected_rows_do_not_match",
        )
        .when(plain, "direct")
        .otherwise("search")
    )


def match_rows(rows: DataFrame, bucket: bool = False) -> DataFrame:
    """(case_id, reason, mapping): reason is NULL when the rows are equal as bags.

    With a bucket column, rows must also be equal bucket by bucket.
    """
    if not bucket:
        rows = rows.withColumn("bucket", F.lit(None).cast("long"))
    judged = value_classes(fingerprints(rows, bucket)).withColumn("verdict", _verdict(F.col("classes")))
    judged = cut(judged, "classes")
    direct = judged.filter(F.col("verdict") == "direct").select(
        "case_id", _direct(F.col("classes")).alias("mapping")
    )
    checked = M.agreement(rows, direct, bucket)
    found = direct.join(checked, "case_id").select(
        "case_id",
        F.when(~F.col("agrees"), "projected_rows_do_not_match").alias("reason"),
        F.when(F.col("agrees"), F.col("mapping")).alias("mapping"),
    )
    failed = judged.filter(~F.col("verdict").isin("direct", "search")).select(
        "case_id", F.col("verdict").alias("reason"), F.lit(None).cast("array<int>").alias("mapping")
    )
    result = found.unionByName(failed)
    ambiguous = judged.filter(F.col("verdict") == "search")
    if not ambiguous.isEmpty():
        options = ambiguous.select("case_id", M.options_of(F.col("classes")).alias("options"))
        searched = M.search(rows, options).select(
            "case_id",
            F.when(F.col("mapping").isNull(), "projected_rows_do_not_match").alias("reason"),
            "mapping",
        )
        result = result.unionByName(searched)
    return result


def match_subsets(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Subset grading: distinct generated rows must be expected rows, in the asked number.

    Distinct rows are written once: read by all later steps, they are shuffled by each step's own key, where one stage
    by case would hold the sorts and tables of all of them in a task.
    """
    distinct = cut(rows.select("case_id", "side", "vals").distinct(), "distinct")
    counts = distinct.groupBy("case_id").agg(
        F.count_if(F.col("side") == "e").alias("n_e"), F.count_if(F.col("side") == "g").alias("n_g")
    )
    op, wanted = F.col("grading.op"), F.col("grading.count")
    n_e, n_g = F.coalesce("n_e", F.lit(0)), F.coalesce("n_g", F.lit(0))
    number_ok = F.when(op == "=", n_g == wanted).otherwise(n_g >= wanted)
    gated = cases.join(counts, "case_id", "left").withColumn(
        "reason",
        F.when(n_g == 0, "no_generated_rows")
        .when(wanted.isNotNull() & ~number_ok, "row_count_mismatch")
        .when(n_e == 0, "generated_rows_not_in_expected"),
    )
    gated = gated.select("case_id", "reason", "n_e", "n_g", "expected.n_cols", "generated.n_cols").toDF(
        "case_id", "reason", "n_e", "n_g", "e_cols", "g_cols"
    )
    none = F.lit(None).cast("array<int>")
    settled = gated.filter(F.col("reason").isNotNull()).select("case_id", "reason", none.alias("mapping"))
    open_cases = gated.filter(F.col("reason").isNull())
    live = cut(distinct.join(open_cases.select("case_id"), "case_id", "left_semi"), "live")
    fits = containing_columns(live).select(
        "case_id", F.explode("expected_cols").alias("col"), F.col("generated_col").alias("g")
    )
    look = fingerprints(live.filter(F.col("side") == "g")).select(
        "case_id", F.col("col").alias("g"), "identity"
    )
    options = (
        fits.join(look, ["case_id", "g"])
        .groupBy("case_id", "col")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("col"), "identity"))).alias("options"))
        .groupBy("case_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.size("options").alias("n"), "col", "options"))
            ).alias("options")
        )
    )
    planned = cut(open_cases.join(options, "case_id", "left"), "subset")
    missing = F.coalesce(F.size("options") < F.col("e_cols"), F.lit(True)) | (F.size("options") < 0)
    not_found = planned.filter(missing).select(
        "case_id", F.lit("expected_column_not_found_in_generated").alias("reason"), none.alias("mapping")
    )
    live = live.withColumn("bucket", F.lit(None).cast("long"))
    # One option per column: nothing to search, only the rows to look up.
    chosen = F.array_sort(
        F.transform("options", lambda o: F.struct(o["col"].alias("e"), o["options"][0]["col"].alias("g")))
    )
    plain = F.forall("options", lambda o: o["n"] == 1) & (
        F.size(F.array_distinct(F.transform("options", lambda o: o["options"][0]["col"]))) == F.size("options")
    )
    open_ended = planned.filter(~missing)
    direct = open_ended.filter(plain).select("case_id", F.transform(chosen, lambda x: x["g"]).alias("mapping"))
    checked = direct.join(M.agreement(live, direct, bucket=False, subset=True), "case_id").select(
        "case_id", F.when(F.col("agrees"), F.col("mapping")).alias("mapping")
    )
    found = checked
    to_search = open_ended.filter(~plain)
    if not to_search.isEmpty():
        found = found.unionByName(M.search(live, to_search, subset=True))
    found = found.select(
        "case_id",
        F.when(F.col("mapping").isNull(), "generated_rows_not_in_expected").alias("reason"),
        "mapping",
    )
    return settled.unionByName(not_found).unionByName(found)


def compare(cases: DataFrame, rows: DataFrame, allow_extra: bool = False,
            modes: tuple[str, ...] | None = None) -> DataFrame:
    """Compare every case; see OUT for the columns of the result.

    matched        rows equal (bag, set or subset, as graded) under some mapping
    order_matched  only where order was asked for: rows also in the expected order
    reason         why not matched; `row_order_mismatch` when only the order differs
    modes          the grading modes that occur, if the caller knows; default: all
                   when cases carry a grading, else only `default`. A case graded
                   in another mode ends the run with an error
    """
    if modes is None:
        modes = ("default", "multiset", "list", "set", "subset") if "grading" in cases.columns else ("default",)
    ordered = "requires_order" in cases.columns or "list" in modes
    cases = _with_defaults(cases).withColumn("gate", gate(allow_extra))
    unlisted = F.concat(F.lit("a case is graded by a mode that is not listed: "), F.col("grading.mode"))
    listed = F.col("grading").isNull() | F.col("grading.mode").isin(*modes)
    cases = cases.withColumn("grading", F.when(listed, F.col("grading")).otherwise(F.raise_error(unlisted)))
    mode = F.col("grading.mode")
    none = F.lit(None).cast("array<int>")
    settled = cases.filter(F.col("gate").isNotNull()).select(
        "case_id",
        F.when(F.col("gate") != "empty", F.col("gate")).alias("reason"),
        none.alias("mapping"),
        (F.col("gate") == "results_truncated").alias("inconclusive"),
        (F.col("gate") == "empty").alias("empty_result"),
    )
    live = cases.filter(F.col("gate").isNull())
    # Written and read again, the cases have no partitions of their own that a join would bring the rows to.
    sizes = cut(live.select("case_id", mode.alias("mode"), (_cells("expected") + _cells("generated")).alias("cells")), "cases")
    rows = by_case(rows, sizes)
    flags = [F.lit(False).alias("inconclusive"), F.lit(False).alias("empty_result")]

    by_bag = [m for m in modes if m != "subset"]
    parts = [settled]
    if by_bag:
        bag_cases = sizes.filter(F.col("mode") != "subset") if "subset" in modes else sizes
        bag_rows = rows.join(bag_cases.select("case_id", "mode"), "case_id")
        if "set" in modes:
            as_set = bag_rows.filter(F.col("mode") == "set")
            distinct = as_set.groupBy("case_id", "side", "vals").agg(F.min("row_id").alias("row_id"))
            counts = distinct.groupBy("case_id").agg(
                F.count_if(F.col("side") == "e").alias("n_e"),
                F.count_if(F.col("side") == "g").alias("n_g"),
            )
            set_cases = bag_cases.filter(F.col("mode") == "set").join(counts, "case_id", "left")
            same = F.coalesce(F.col("n_e") == F.col("n_g"), F.lit(True))
            hollow = F.col("n_e").isNull()
            parts.append(
                set_cases.filter(hollow | ~same).select(
                    "case_id",
                    F.when(~hollow, "row_count_mismatch").alias("reason"),
                    none.alias("mapping"),
                    F.lit(False).alias("inconclusive"),
                    hollow.alias("empty_result"),
                )
            )
            even = set_cases.filter(~hollow & same).select("case_id")
            bag_rows = bag_rows.filter(F.col("mode") != "set").select(
                "case_id", "side", "row_id", "vals"
            ).unionByName(
                distinct.join(even, "case_id").select("case_id", "side", "row_id", "vals")
            )
        else:
            bag_rows = bag_rows.select("case_id", "side", "row_id", "vals")
        bags = match_rows(bag_rows)
        parts.append(bags.select("case_id", "reason", "mapping", *flags))
    if "subset" in modes:
        sub_cases = live.filter(mode == "subset")
        sub_rows = rows.join(sizes.filter(F.col("mode") == "subset").select("case_id"), "case_id")
        subs = match_subsets(sub_rows, sub_cases)
        parts.append(subs.select("case_id", "reason", "mapping", *flags))

    found = parts[1]
    for part in parts[2:]:
        found = found.unionByName(part)
    # Start from the cases: one of which no row or no column came is found by no cell.
    found = live.select("case_id", F.col("expected.n_cols").alias("_width")).join(found.withColumn("_found", F.lit(True)), "case_id", "left")
    bare = F.col("_found").isNull()
    result = settled.unionByName(
        found.select(
            "case_id",
            F.when(bare & (F.col("_width") > 0), "expected_column_not_found_in_generated").otherwise(F.col("reason")).alias("reason"),
            F.when(bare & (F.col("_width") == 0), F.expr("cast(array() AS array<int>)")).otherwise(F.col("mapping")).alias("mapping"),
            F.coalesce("inconclusive", F.lit(False)).alias("inconclusive"),
            F.coalesce("empty_result", F.lit(False)).alias("empty_result"),
        )
    )
    if not ordered:
        return result.select(
            "case_id",
            F.col("reason").isNull().alias("matched"),
            F.lit(None).cast("boolean").alias("order_matched"),
            "reason", "inconclusive", "empty_result", "mapping",
        )

    result = cut(result, "unordered")
    wants_order = F.when(mode == "list", True).when(
        mode.isin("set", "multiset", "subset"), False
    ).otherwise(F.coalesce("requires_order", F.lit(False)))
    asked = (
        cases.filter(wants_order)
        .select("case_id", "order_keys")
        .join(
            result.filter(F.col("reason").isNull()).select("case_id", "empty_result"), "case_id"
        )
    )
    asked = cut(asked, "ordered")
    placed = with_order_bucket(
        rows.select("case_id", "side", "row_id", "vals"), asked.filter(~F.col("empty_result"))
    )
    in_order = match_rows(placed, bucket=True).select(
        "case_id", F.col("reason").isNull().alias("in_order"), F.col("mapping").alias("ordered_mapping")
    )
    asked = asked.select("case_id", F.lit(True).alias("asked"))
    joined = result.join(asked, "case_id", "left").join(in_order, "case_id", "left")
    order_matched = F.when(
        F.col("asked"), F.col("empty_result") | F.coalesce("in_order", F.lit(False))
    )
    return joined.select(
        "case_id",
        F.col("reason").isNull().alias("matched"),
        order_matched.alias("order_matched"),
        F.when(
            F.col("reason").isNull() & (order_matched == False), "row_order_mismatch"  # noqa: E712
        ).otherwise(F.col("reason")).alias("reason"),
        "inconclusive",
        "empty_result",
        F.coalesce("ordered_mapping", "mapping").alias("mapping"),
    )

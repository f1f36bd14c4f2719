"""Result comparison: customers' orders as the results of many questions.

A case is a customer. The expected result is the customer's orders (key, date,
price); the generated one differs by a fixed rule of the customer key. The SQL
does not know the rule's outcome: it tries every assignment of columns on the
rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.functions.cells import tag_number, tag_text, tag_timestamp, with_cells
from tallygrade.functions.grading import parse_grading
from tallygrade.operators import bags
from tallygrade.operators.columns import (
    candidate_pairs, containing_columns, fingerprints, value_classes,
)
from tallygrade.operators.compare import compare, gate
from tallygrade.operators.outcomes import execution_match, with_order_policy
from tallygrade.operators.positions import same_positions, tie_runs
from tallygrade.session import cut

# ---------------------------------------------------------------- graded orders



def base_orders(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select(
        F.col("o_custkey").alias("case_id"),
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
        (F.col("o_custkey") % 9).alias("k"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.count("*").over(whole).alias("n"),
        F.coalesce(
            F.lead("o_totalprice").over(w), F.first("o_totalprice").over(whole)
        ).alias("next_price"),
    )


def expected_rows(o: DataFrame) -> DataFrame:
    vals = F.array(
        tag_number(F.col("o_orderkey")), tag_timestamp(F.col("o_orderdate")), tag_number(F.col("o_totalprice"))
    )
    return o.select("case_id", F.lit("e").alias("side"), F.col("pos").cast("long").alias("row_id"), vals.alias("vals"))


def generated_rows(o: DataFrame) -> DataFrame:
    k = F.col("k")
    first = F.col("pos") == 0
    price = F.when((k == 2) & first, F.col("o_totalprice") + 1).when(k == 3, F.col("next_price")).otherwise(
        F.col("o_totalprice")
    )
    copies = F.when((k == 1) & (F.col("pos") == F.col("n") - 1), 0).when((k == 5) & first, 2).otherwise(1)
    raw = o.filter(k != 7).withColumns(
        {
            "price": price,
            "money": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
            "iso": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            "copies": copies,
        }
    )
    cells = with_cells(raw, ["o_orderkey", "o_orderdate", "price", "o_orderstatus", "money", "iso"], "c")
    slots = (
        F.when(k == 0, F.array(*map(F.lit, (5, 1, 6))))
        .when(k == 4, F.array(*map(F.lit, (1, 4, 2, 3))))
        .when(k == 6, F.array(*map(F.lit, (1, 2))))
        .otherwise(F.array(*map(F.lit, (1, 2, 3))))
    )
    vals = F.transform(slots, lambda i: F.element_at("c", i))
    return cells.filter("copies > 0").select(
        "case_id", F.lit("g").alias("side"), F.col("pos").cast("long").alias("row_id"),
        vals.alias("vals"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"),
    ).drop("_copy")


def graded_cases(t: Tables, rows: DataFrame) -> DataFrame:
    """Shapes counted from the rows; some sides failed or cut by rule."""
    counts = rows.groupBy("case_id").agg(
        F.count_if(F.col("side") == "e").alias("ne"), F.count_if(F.col("side") == "g").alias("ng")
    )
    c, k, cut = F.col("case_id"), F.col("case_id") % 9, F.col("case_id") % 13
    null = F.lit(None).cast("long")

    def shape(ok: Column, cols: Column, n: str, is_cut: Column, total: Column) -> Column:
        return F.struct(
            ok.alias("ok"), cols.cast("int").alias("n_cols"), F.col(n).alias("n_rows"),
            is_cut.alias("cut"), total.alias("total"),
        )

    three = F.lit(3)
    g_cols = F.when(k == 4, 4).when(k == 6, 2).otherwise(3)
    return counts.select(
        "case_id",
        shape(k != 8, three, "ne", cut.isin(0, 1), F.when(cut == 0, F.lit(5000).cast("long"))).alias("expected"),
        shape(k != 7, g_cols, "ng", cut.isin(0, 2), F.when(cut == 0, F.when(c % 2 == 0, 5000).otherwise(1200).cast("long"))).alias("generated"),
    )


def graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = base_orders(t)
    # Captured once, like any result that is to be compared.
    rows = cut(expected_rows(o).unionByName(generated_rows(o)), "captured")
    return graded_cases(t, rows), rows


GRADED = """
o AS (
  SELECT o_custkey c, o_custkey % 9 k, o_orderkey::VARCHAR ok, strftime(o_orderdate, '%Y-%m-%d') d,
         o_totalprice p, lower(o_orderstatus) s, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY o_custkey) n,
         coalesce(lead(o_totalprice) OVER w, first_value(o_totalprice) OVER w) np
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT c, list([ok, d, round(p, 6)::VARCHAR] ORDER BY pos) AS el, count(*) AS ne FROM o GROUP BY c),
gr AS (
  SELECT c, pos, CASE k
      WHEN 0 THEN [round(p, 6)::VARCHAR, ok, d]
      WHEN 2 THEN [ok, d, round(CASE WHEN pos = 0 THEN p + 1 ELSE p END, 6)::VARCHAR]
      WHEN 3 THEN [ok, d, round(np, 6)::VARCHAR]
      WHEN 4 THEN [ok, s, d, round(p, 6)::VARCHAR]
      WHEN 6 THEN [ok, d]
      ELSE [ok, d, round(p, 6)::VARCHAR] END AS v
  FROM o, generate_series(1, CASE WHEN k = 5 AND pos = 0 THEN 2 ELSE 1 END)
  WHERE k <> 7 AND NOT (k = 1 AND pos = n - 1)),
g AS (SELECT c, list(v ORDER BY pos) AS gl, count(*) AS ng FROM gr GROUP BY c),
pairs AS (
  SELECT e.c, el, coalesce(gl, []) AS gl, ne, coalesce(ng, 0) AS ng,
         CASE e.c % 9 WHEN 4 THEN 4 WHEN 6 THEN 2 ELSE 3 END AS gc,
         e.c % 9 <> 8 AS eok, e.c % 9 <> 7 AS gok,
         e.c % 13 IN (0, 1) AS ecut, e.c % 13 IN (0, 2) AS gcut,
         e.c % 13 = 0 AND e.c % 2 = 1 AS totals_differ
  FROM e LEFT JOIN g USING (c))
"""


def assignments(n_exp: int, n_gen: int, el: str, gl: str, distinct: bool = False) -> str:
    """SQL: does some choice of n_exp of n_gen columns make the rows equal?"""
    wrap = (lambda x: f"list_sort(list_distinct({x}))") if distinct else (lambda x: f"list_sort({x})")
    tests = [
        f"{wrap('[[' + ', '.join(f'x[{j + 1}]' for j in p) + f'] FOR x IN {gl}]')} = {wrap(el)}"
        for p in permutations(range(n_gen), n_exp)
    ]
    return "(" + " OR ".join(tests) + ")"


def columns_found(n_exp: int, n_gen: int, el: str, gl: str) -> str:
    """SQL: has every expected column a generated one with the same values?"""
    per = []
    for i in range(1, n_exp + 1):
        some = " OR ".join(
            f"list_sort([x[{j}] FOR x IN {gl}]) = list_sort([x[{i}] FOR x IN {el}])" for j in range(1, n_gen + 1)
        )
        per.append(f"({some})")
    return "(" + " AND ".join(per) + ")"


def reason_sql(allow_extra: bool) -> str:
    wide = "" if allow_extra else "WHEN gc <> 3 THEN 'column_count_mismatch'"
    return f"""CASE
      WHEN NOT eok THEN 'expected_sql_execution_failed'
      WHEN NOT gok THEN 'generated_sql_execution_failed'
      WHEN gc < 3 THEN 'insufficient_generated_columns' {wide}
      WHEN ecut AND gcut THEN CASE WHEN totals_differ THEN 'row_count_mismatch' ELSE 'results_truncated' END
      WHEN ecut OR gcut THEN 'row_count_mismatch'
      WHEN ne <> ng THEN 'row_count_mismatch'
      WHEN ne = 0 THEN NULL
      WHEN NOT CASE WHEN gc = 4 THEN {columns_found(3, 4, 'el', 'gl')} ELSE {columns_found(3, 3, 'el', 'gl')} END
        THEN 'expected_column_not_found_in_generated'
      WHEN NOT CASE WHEN gc = 4 THEN {assignments(3, 4, 'el', 'gl')} ELSE {assignments(3, 3, 'el', 'gl')} END
        THEN 'projected_rows_do_not_match' END"""


def outcome_sql(allow_extra: bool) -> str:
    return f"""WITH {GRADED}, r AS (SELECT c, ne, {reason_sql(allow_extra)} AS reason FROM pairs)
    SELECT c AS case_id, reason IS NULL AS matched, reason, reason IS NOT DISTINCT FROM 'results_truncated' AS inconclusive,
           reason IS NULL AND ne = 0 AS empty_result FROM r"""


OUTCOME = "case_id bigint, matched boolean, reason string, inconclusive boolean, empty_result boolean"


@check(OUTCOME, outcome_sql(True))
def compare_contains(t: Tables) -> DataFrame:
    """Every expected column is in the generated result, with the same rows."""
    return compare(*graded(t), allow_extra=True)


@check(OUTCOME, outcome_sql(False))
def compare_exact(t: Tables) -> DataFrame:
    """The same without extra columns."""
    return compare(*graded(t), allow_extra=False)


def match_sql(allow_extra: bool) -> str:
    return f"""WITH {GRADED}, r AS (SELECT c, {reason_sql(allow_extra)} AS reason FROM pairs),
    s AS (SELECT c, c % 10 = 0 AS no_gold, NOT (c % 9 <> 8) AS gold_failed, c % 9 = 7 AND c % 2 = 0 AS no_answer, reason FROM r)
    SELECT c AS case_id,
      CASE WHEN no_gold THEN 'no_expected_sql' WHEN gold_failed THEN 'expected_sql_execution_failed'
           WHEN no_answer THEN 'no_generated_sql' ELSE reason END AS reason,
      NOT (no_gold OR gold_failed OR (NOT no_answer AND coalesce(reason = 'results_truncated', false))) AS applicable,
      CASE WHEN NOT no_gold AND NOT gold_failed AND NOT no_answer AND reason IS NULL THEN 1.0 ELSE 0.0 END AS score
    FROM s"""


def as_cases(cases: DataFrame) -> DataFrame:
    """Texts and missing answers by rule: some cases have no gold SQL, some no answer."""
    c = F.col("case_id")
    gone = (c % 9 == 7) & (c % 2 == 0)
    return cases.withColumns(
        {
            "expected_sql": F.when(c % 10 == 0, "").otherwise("select gold"),
            "generated_sql": F.when(~gone, "select answer"),
            "generated": F.when(~gone, F.col("generated")),
        }
    )


MATCH = "case_id bigint, reason string, applicable boolean, score double"


@check(MATCH, match_sql(False))
def execution_accuracy(t: Tables) -> DataFrame:
    """Execution accuracy with its rules of applicability."""
    cases, rows = graded(t)
    cases = as_cases(cases)
    return execution_match(cases, compare(cases, rows, allow_extra=False), "execution_accuracy")


@check(MATCH, match_sql(True))
def contains_accuracy(t: Tables) -> DataFrame:
    """Contains accuracy with its rules of applicability."""
    cases, rows = graded(t)
    cases = as_cases(cases)
    return execution_match(cases, compare(cases, rows, allow_extra=True), "contains_accuracy")


# ---------------------------------------------------------------- gates alone

@check(
    "case_id bigint, extra boolean, outcome string",
    f"""WITH {GRADED}, b AS (SELECT c, ne, ng, gc, eok, gok, ecut, gcut, totals_differ, c % 4 AS mode FROM pairs),
    x AS (SELECT *, unnest([true, false]) AS extra FROM b)
    SELECT c AS case_id, extra, CASE
      WHEN NOT eok THEN 'expected_sql_execution_failed'
      WHEN NOT gok THEN 'generated_sql_execution_failed'
      WHEN gc < 3 THEN 'insufficient_generated_columns'
      WHEN NOT extra AND gc <> 3 THEN 'column_count_mismatch'
      WHEN (ecut OR gcut) AND mode IN (1, 2) THEN 'results_truncated'
      WHEN ecut AND gcut THEN CASE WHEN totals_differ THEN 'row_count_mismatch' ELSE 'results_truncated' END
      WHEN ecut OR gcut THEN 'row_count_mismatch'
      WHEN mode IN (0, 3) AND ne <> ng THEN 'row_count_mismatch' END AS outcome FROM x""",
)
def shape_and_truncation_gates(t: Tables) -> DataFrame:
    """Cases settled by their shapes, in the order of the rules."""
    cases, _ = graded(t)
    mode = F.element_at(F.array(*map(F.lit, ("default", "set", "subset", "multiset"))), (F.col("case_id") % 4 + 1).cast("int"))
    cases = cases.withColumn("grading", F.struct(mode.alias("mode")))
    parts = [
        cases.select("case_id", F.lit(x).alias("extra"), gate(x).alias("outcome")) for x in (True, False)
    ]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- gradings

@check(
    "case_id bigint, mode string, matched boolean, reason string",
    f"""WITH {GRADED}, b AS (SELECT *, CASE c % 3 WHEN 1 THEN 'set' WHEN 2 THEN 'multiset' ELSE 'default' END AS mode,
        list_distinct(el) AS ed, list_distinct(gl) AS gd FROM pairs),
    r AS (SELECT c, mode, CASE
      WHEN NOT eok THEN 'expected_sql_execution_failed'
      WHEN NOT gok THEN 'generated_sql_execution_failed'
      WHEN gc < 3 THEN 'insufficient_generated_columns'
      WHEN (ecut OR gcut) AND mode = 'set' THEN 'results_truncated'
      WHEN ecut AND gcut THEN CASE WHEN totals_differ THEN 'row_count_mismatch' ELSE 'results_truncated' END
      WHEN ecut OR gcut THEN 'row_count_mismatch'
      WHEN mode = 'set' AND len(ed) <> len(gd) THEN 'row_count_mismatch'
      WHEN mode <> 'set' AND ne <> ng THEN 'row_count_mismatch'
      WHEN NOT CASE WHEN gc = 4 THEN {columns_found(3, 4, 'ed', 'gd')} ELSE {columns_found(3, 3, 'ed', 'gd')} END
        THEN 'expected_column_not_found_in_generated'
      WHEN NOT CASE WHEN gc = 4 THEN {assignments(3, 4, 'ed', 'gd')} ELSE {assignments(3, 3, 'ed', 'gd')} END
        THEN 'projected_rows_do_not_match' END AS reason FROM b)
    SELECT c AS case_id, mode, reason IS NULL AS matched, reason FROM r""",
)
def grading_set_and_multiset(t: Tables) -> DataFrame:
    """Set grading ignores copies of rows; multiset grading does not."""
    cases, rows = graded(t)
    method = F.when(F.col("case_id") % 3 == 1, " SET").when(F.col("case_id") % 3 == 2, "multiset")
    cases = cases.withColumn("grading", parse_grading(method))
    out = compare(cases, rows, allow_extra=True, modes=("default", "set", "multiset"))
    return out.join(cases.select("case_id", F.col("grading.mode").alias("mode")), "case_id")


SUBSET = """
o AS (SELECT o_custkey c, o_custkey % 5 k, o_orderkey::VARCHAR ok, o_orderpriority pr, o_orderstatus s,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 pos FROM orders),
e AS (SELECT c, list([ok, pr, s]) AS el FROM o GROUP BY c),
g AS (SELECT c, list(CASE WHEN k = 1 THEN [pr, ok, s] WHEN k = 2 AND pos = 0 THEN [ok, pr, 'Z'] WHEN k = 3 AND pos = 0 THEN [ok, '1-URGENT', s] ELSE [ok, pr, s] END) AS gl
      FROM o WHERE pos < 3 AND k <> 4 GROUP BY c),
pairs AS (SELECT e.c, list_distinct(el) AS el, list_distinct(coalesce(gl, [])) AS gl, e.c % 3 AS m FROM e LEFT JOIN g USING (c))
"""


def subset_found(n: int, of: int) -> str:
    tests = [
        "len(list_filter([[" + ", ".join(f"x[{j + 1}]" for j in p) + "] FOR x IN gl], lambda y: NOT list_contains(el, y))) = 0"
        for p in permutations(range(of), n)
    ]
    return "(" + " OR ".join(tests) + ")"


def subset_columns() -> str:
    per = []
    for i in (1, 2, 3):
        per.append("(" + " OR ".join(
            f"list_has_all([x[{i}] FOR x IN el], [x[{j}] FOR x IN gl])" for j in (1, 2, 3)) + ")")
    return "(" + " AND ".join(per) + ")"


def subset_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t.orders.select(
        F.col("o_custkey").alias("case_id"), (F.col("o_custkey") % 5).alias("k"),
        tag_number(F.col("o_orderkey")).alias("ok"), tag_text(F.col("o_orderpriority")).alias("pr"),
        tag_text(F.col("o_orderstatus")).alias("s"), (F.row_number().over(w) - 1).cast("long").alias("row_id"),
    )
    k, first = F.col("k"), F.col("row_id") == 0
    g = (
        F.when(k == 1, F.array("pr", "ok", "s"))
        .when((k == 2) & first, F.array(F.col("ok"), F.col("pr"), F.lit("t:z")))
        .when((k == 3) & first, F.array(F.col("ok"), F.lit("t:1-urgent"), F.col("s")))
        .otherwise(F.array("ok", "pr", "s"))
    )
    rows = o.select("case_id", F.lit("e").alias("side"), "row_id", F.array("ok", "pr", "s").alias("vals")).unionByName(
        o.filter((F.col("row_id") < 3) & (k != 4)).select("case_id", F.lit("g").alias("side"), "row_id", g.alias("vals"))
    )
    rows = cut(rows, "captured")
    counts = rows.groupBy("case_id").agg(F.count_if(F.col("side") == "e").alias("ne"), F.count_if(F.col("side") == "g").alias("ng"))
    method = F.when(F.col("case_id") % 3 == 0, "subset,=,3").when(F.col("case_id") % 3 == 1, "subset, >= ,2").otherwise("subset")
    shape = lambda n: F.struct(F.lit(True).alias("ok"), F.lit(3).alias("n_cols"), F.col(n).alias("n_rows"),
                               F.lit(False).alias("cut"), F.lit(None).cast("long").alias("total"))
    cases = counts.select("case_id", shape("ne").alias("expected"), shape("ng").alias("generated"), parse_grading(method).alias("grading"))
    return cases, rows


@check(
    "case_id bigint, matched boolean, reason string",
    f"""WITH {SUBSET}, r AS (SELECT c, CASE
      WHEN len(gl) = 0 THEN 'no_generated_rows'
      WHEN m = 0 AND len(gl) <> 3 OR m = 1 AND len(gl) < 2 THEN 'row_count_mismatch'
      WHEN NOT {subset_columns()} THEN 'expected_column_not_found_in_generated'
      WHEN NOT {subset_found(3, 3)} THEN 'generated_rows_not_in_expected' END AS reason FROM pairs)
    SELECT c AS case_id, reason IS NULL AS matched, reason FROM r""",
)
def grading_subset(t: Tables) -> DataFrame:
    """Any three (or two, or some) of the valid rows will do."""
    return compare(*subset_inputs(t), allow_extra=True, modes=("subset",))


@check(
    "case_id bigint, contained boolean",
    f"""WITH {SUBSET} SELECT c AS case_id, len(list_filter(gl, lambda y: NOT list_contains(el, y))) = 0 AS contained FROM pairs""",
)
def rows_subset(t: Tables) -> DataFrame:
    """Every distinct generated row is an expected row, columns as they stand."""
    return bags.subset_of_expected(subset_inputs(t)[1], ["vals"])


@check(
    "case_id bigint, generated_col bigint, expected_cols string",
    f"""WITH {SUBSET}, j AS (SELECT c, el, gl, unnest([1, 2, 3]) AS j FROM pairs WHERE len(gl) > 0)
    SELECT c AS case_id, j - 1 AS generated_col, array_to_string(list_filter([
      {', '.join(f'CASE WHEN list_has_all([x[{i}] FOR x IN el], [x[j] FOR x IN gl]) THEN {i - 1} END' for i in (1, 2, 3))}
    ], lambda y: y IS NOT NULL), ',') AS expected_cols FROM j""",
)
def subset_candidate_columns(t: Tables) -> DataFrame:
    """Which expected columns hold all values of a generated column."""
    found = containing_columns(subset_inputs(t)[1].select("case_id", "side", "vals").distinct())
    return found.withColumn("expected_cols", F.concat_ws(",", "expected_cols"))


# ---------------------------------------------------------------- order

ORDERED = """
o AS (SELECT o_custkey c, o_custkey % 5 k, o_orderpriority pr, o_orderkey ok FROM orders),
e AS (SELECT c, k, pr, ok, row_number() OVER (PARTITION BY c ORDER BY pr, ok) - 1 AS pos FROM o),
g AS (SELECT c, pr, ok, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN k = 1 THEN NULL ELSE pr END,
        CASE WHEN k = 3 THEN ok ELSE -ok END) - 1 AS pos FROM o),
runs AS (SELECT *, sum(CASE WHEN pr IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY pos) AS run
         FROM (SELECT *, lag(pr) OVER (PARTITION BY c ORDER BY pos) AS prev FROM e)),
strict AS (SELECT e.c, bool_and(e.pr = g.pr AND e.ok = g.ok) AS same FROM e JOIN g ON e.c = g.c AND e.pos = g.pos GROUP BY e.c),
er AS (SELECT c, run, list_sort(list(ok)) AS l FROM runs GROUP BY c, run),
gr AS (SELECT g.c, r.run, list_sort(list(g.ok)) AS l, bool_and(g.pr = r.pr) AS keys_ok FROM g JOIN runs r ON g.c = r.c AND g.pos = r.pos GROUP BY g.c, r.run),
tied AS (SELECT er.c, bool_and(er.l = gr.l AND keys_ok) AS same FROM er JOIN gr ON er.c = gr.c AND er.run = gr.run GROUP BY er.c)
"""


def ordered_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_custkey") % 5).alias("k"),
                        F.col("o_orderpriority").alias("pr"), F.col("o_orderkey").alias("ok"))
    part = Window.partitionBy("case_id")
    by_e = part.orderBy("pr", "ok")
    by_g = part.orderBy(F.when(F.col("k") != 1, F.col("pr")), F.when(F.col("k") == 3, F.col("ok")).otherwise(-F.col("ok")))
    vals = F.array(tag_text(F.col("pr")), tag_number(F.col("ok")))
    rows = o.select("case_id", F.lit("e").alias("side"), (F.row_number().over(by_e) - 1).cast("long").alias("row_id"), vals.alias("vals")).unionByName(
        o.select("case_id", F.lit("g").alias("side"), (F.row_number().over(by_g) - 1).cast("long").alias("row_id"), vals.alias("vals"))
    )
    rows = cut(rows, "captured")
    n = rows.groupBy("case_id").agg(F.count_if(F.col("side") == "e").alias("n"))
    shape = F.struct(F.lit(True).alias("ok"), F.lit(2).alias("n_cols"), F.col("n").alias("n_rows"),
                     F.lit(False).alias("cut"), F.lit(None).cast("long").alias("total"))
    cases = n.select(
        "case_id", shape.alias("expected"), shape.alias("generated"),
        (F.col("case_id") % 5 != 4).alias("requires_order"),
        F.when(F.col("case_id") % 5 != 2, F.array(F.lit(0))).alias("order_keys"),
    )
    return cases, rows


ORDER_MATCHED = "CASE WHEN c % 5 = 4 THEN NULL WHEN c % 5 = 2 THEN s.same ELSE s.same OR td.same END"


@check(
    "case_id bigint, matched boolean, order_matched boolean, reason string",
    f"""WITH {ORDERED}, r AS (SELECT s.c, {ORDER_MATCHED.replace('c % 5', 's.c % 5')} AS om FROM strict s JOIN tied td ON s.c = td.c)
    SELECT c AS case_id, true AS matched, om AS order_matched,
           CASE WHEN om = false THEN 'row_order_mismatch' END AS reason FROM r""",
)
def compare_in_order(t: Tables) -> DataFrame:
    """Rows in the expected order; rows that tie on the sort key may trade places."""
    return compare(*ordered_inputs(t), allow_extra=False)


@check(
    "case_id bigint, matched boolean, order_matched boolean, reason string",
    f"WITH {ORDERED} SELECT c AS case_id, true AS matched, same AS order_matched, CASE WHEN NOT same THEN 'row_order_mismatch' END AS reason FROM strict",
)
def grading_list(t: Tables) -> DataFrame:
    """List grading: the same rows in the same order, whatever a case says about its order."""
    cases, rows = ordered_inputs(t)
    cases = cases.drop("order_keys").withColumn("grading", parse_grading(F.lit(" List ")))
    return compare(cases, rows, allow_extra=False, modes=("list",))


@check("case_id bigint, equal boolean", f"WITH {ORDERED} SELECT c AS case_id, same AS equal FROM strict")
def rows_equal_by_position(t: Tables) -> DataFrame:
    """Rows equal position by position."""
    return same_positions(ordered_inputs(t)[1])


@check(
    "case_id bigint, row_id bigint, run bigint",
    f"WITH {ORDERED} SELECT c AS case_id, pos AS row_id, min(pos) OVER (PARTITION BY c, run) AS run FROM runs",
)
def runs_of_ties(t: Tables) -> DataFrame:
    """Where each run of equal sort keys starts."""
    e = ordered_inputs(t)[1].filter(F.col("side") == "e")
    return tie_runs(e.select("case_id", "row_id", F.slice("vals", 1, 1).alias("key")), block_rows=4)


@check(
    "case_id bigint, matched boolean, score double, order_policy string, order_not_verified boolean, reason string",
    f"""WITH {ORDERED}, r AS (SELECT s.c, {ORDER_MATCHED.replace('c % 5', 's.c % 5')} AS om,
        CASE s.c % 3 WHEN 0 THEN true WHEN 1 THEN false END AS decision FROM strict s JOIN tied td ON s.c = td.c)
    SELECT c AS case_id, true AS matched, CASE WHEN om = false AND decision THEN 0.0 ELSE 1.0 END AS score,
      CASE WHEN om THEN 'order matches' WHEN om = false AND decision THEN 'order differs; the question asks for an order'
           WHEN om = false AND NOT decision THEN 'order differs; the question does not ask for an order'
           WHEN om = false THEN 'order differs; not verified' END AS order_policy,
      coalesce(om = false AND decision IS NULL, false) AS order_not_verified,
      CASE WHEN om = false AND decision THEN 'row_order_mismatch' END AS reason FROM r""",
)
def order_policy_decides(t: Tables) -> DataFrame:
    """A different order fails only where the question asks for an order."""
    cases, rows = ordered_inputs(t)
    c = F.col("case_id")
    policies = cases.select(
        "case_id", F.lit("default").alias("grading_mode"),
        F.when(c % 3 == 0, True).when(c % 3 == 1, False).alias("decision"),
    )
    out = with_order_policy(compare(cases, rows, allow_extra=False), policies)
    return out.withColumn("score", F.when(F.col("reason").isNull(), 1.0).otherwise(0.0))


# ---------------------------------------------------------------- look-alike columns

FLAGS = """
p AS (SELECT p_brand b, p_partkey pk, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS f1 FROM part),
q AS (SELECT b, pk, f1, row_number() OVER (PARTITION BY b ORDER BY pk) AS i, count(*) OVER (PARTITION BY b) AS n FROM p),
w AS (SELECT q.b, q.pk, q.f1, r.f1 AS f2 FROM q JOIN q r ON q.b = r.b AND r.i = q.n + 1 - q.i),
lists AS (SELECT b, list([f1, f2]) AS el,
  list(CASE WHEN CAST(substr(b, 7) AS INT) % 3 = 0 THEN [f2, f1] WHEN CAST(substr(b, 7) AS INT) % 3 = 1 THEN [f2, f2] ELSE [f1, f2] END) AS gl,
  list([CASE WHEN pk % 7 = 0 THEN f1 ELSE 1 - f1 END]) AS odd FROM w GROUP BY b)
"""


def flag_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = Window.partitionBy("p_brand")
    q = t.part.select(
        "p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("f1"),
        F.row_number().over(part.orderBy("p_partkey")).alias("i"), F.count("*").over(part).alias("n"),
    )
    mirror = q.select("p_brand", F.col("f1").alias("f2"), (F.col("n") + 1 - F.col("i")).alias("i"))
    w = q.join(mirror, ["p_brand", "i"])
    m = F.substring("p_brand", 7, 9).cast("int") % 3
    a, b = tag_number(F.col("f1")), tag_number(F.col("f2"))
    g = F.when(m == 0, F.array(b, a)).when(m == 1, F.array(b, b)).otherwise(F.array(a, b))
    both = w.select(F.col("p_brand").alias("case_id"), F.array(a, b).alias("e"), g.alias("g"))
    rows = both.select(
        "case_id",
        F.inline(F.array(F.struct(F.lit("e").alias("side"), F.col("e").alias("vals")),
                         F.struct(F.lit("g").alias("side"), F.col("g").alias("vals")))),
    ).withColumn("row_id", F.lit(None).cast("long"))
    rows = cut(rows, "captured")
    n = rows.groupBy("case_id").agg(F.count_if(F.col("side") == "e").alias("n"))
    shape = F.struct(F.lit(True).alias("ok"), F.lit(2).alias("n_cols"), F.col("n").alias("n_rows"),
                     F.lit(False).alias("cut"), F.lit(None).cast("long").alias("total"))
    return n.select("case_id", shape.alias("expected"), shape.alias("generated")), rows


@check(
    "case_id string, matched boolean, reason string",
    f"""WITH {FLAGS} SELECT b AS case_id, {assignments(2, 2, 'el', 'gl')} AS matched,
    CASE WHEN NOT {columns_found(2, 2, 'el', 'gl')} THEN 'expected_column_not_found_in_generated'
         WHEN NOT {assignments(2, 2, 'el', 'gl')} THEN 'projected_rows_do_not_match' END AS reason FROM lists""",
)
def mapping_of_equal_flags(t: Tables) -> DataFrame:
    """Two flags with the same counts: the values alone do not say which is which."""
    return compare(*flag_inputs(t), allow_extra=False)


@check(
    "case_id string, expected_col bigint, generated_cols string",
    f"""WITH {FLAGS}, i AS (SELECT b, el, gl, unnest([1, 2]) AS i FROM lists)
    SELECT b AS case_id, i - 1 AS expected_col, array_to_string(list_filter([
      CASE WHEN list_sort([x[1] FOR x IN gl]) = list_sort([x[i] FOR x IN el]) THEN 0 END,
      CASE WHEN list_sort([x[2] FOR x IN gl]) = list_sort([x[i] FOR x IN el]) THEN 1 END
    ], lambda y: y IS NOT NULL), ',') AS generated_cols FROM i""",
)
def candidate_columns(t: Tables) -> DataFrame:
    """Generated columns with the values of each expected column."""
    rows = flag_inputs(t)[1]
    return candidate_pairs(value_classes(fingerprints(rows))).withColumn(
        "generated_cols", F.concat_ws(",", "generated_cols")
    )


@check(
    "case_id bigint, col bigint, candidates bigint, place bigint",
    f"""WITH {GRADED}, i AS (SELECT c, el, gl, gc, unnest([1, 2, 3]) AS i FROM pairs),
    n AS (SELECT c, i - 1 AS col, len(list_filter(range(1, gc + 1), lambda j: list_sort([x[j] FOR x IN gl]) = list_sort([x[i] FOR x IN el]))) AS candidates FROM i)
    SELECT c AS case_id, col, candidates, row_number() OVER (PARTITION BY c ORDER BY candidates, col) - 1 AS place FROM n""",
)
def search_order(t: Tables) -> DataFrame:
    """Columns in the order a search takes them: fewest candidates first."""
    from tallygrade.operators.mapping import options_of

    classes = value_classes(fingerprints(graded(t)[1]))
    return classes.select("case_id", F.posexplode(options_of(F.col("classes"))).alias("place", "o")).select(
        "case_id", "o.col", F.size("o.options").alias("candidates"), "place"
    )


# ---------------------------------------------------------------- bags and sets

@check(
    "case_id bigint, equal boolean",
    f"WITH {GRADED} SELECT c AS case_id, list_sort(el) = list_sort(gl) AS equal FROM pairs",
)
def bags_equal(t: Tables) -> DataFrame:
    """Rows equal as bags, columns as they stand."""
    rows = graded(t)[1]
    return bags.bag_equal(rows, ["vals"])


@check(
    "case_id bigint, equal boolean",
    f"WITH {GRADED} SELECT c AS case_id, list_sort(list_distinct(el)) = list_sort(list_distinct(gl)) AS equal FROM pairs",
)
def sets_equal(t: Tables) -> DataFrame:
    """Distinct rows equal, columns as they stand."""
    rows = graded(t)[1]
    return bags.set_equal(rows, ["vals"])


@check(
    "o_custkey bigint, o_orderpriority string, shared bigint, missing bigint, extra bigint",
    """WITH e AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
    g AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
    SELECT o_custkey, o_orderpriority, least(coalesce(e.n, 0), coalesce(g.n, 0)) AS shared,
      greatest(coalesce(e.n, 0) - coalesce(g.n, 0), 0) AS missing, greatest(coalesce(g.n, 0) - coalesce(e.n, 0), 0) AS extra
    FROM e FULL JOIN g USING (o_custkey, o_orderpriority)""",
)
def bag_overlap(t: Tables) -> DataFrame:
    """Shared, missing and extra items of two bags."""
    both = F.array_compact(F.array(F.when(F.col("o_orderkey") % 2 == 0, "e"), F.when(F.col("o_orderkey") % 3 == 0, "g")))
    rows = t.orders.select("o_custkey", "o_orderpriority", F.explode(both).alias("side"))
    return bags.bag_difference(rows, ["o_custkey"], "o_orderpriority")


@check(
    "o_custkey bigint, o_orderpriority string, o_orderstatus string, n bigint",
    "SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
)
def row_bag(t: Tables) -> DataFrame:
    """How often each row occurs in a result."""
    rows = t.orders.select(F.col("o_custkey"), "o_orderpriority", "o_orderstatus", F.lit("e").alias("side"))
    return bags.row_counts(rows, ["o_orderpriority", "o_orderstatus"], "o_custkey").withColumnRenamed("in_expected", "n")


@check(
    "o_custkey bigint, o_orderpriority string, first_at bigint",
    "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY ALL",
)
def distinct_in_first_order(t: Tables) -> DataFrame:
    """Distinct rows with the place where each came first."""
    rows = t.orders.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("first_at"))
    return bags.first_occurrences(rows, ["o_custkey"], "o_orderpriority", "first_at")


# ---------------------------------------------------------------- gold on two engines

GOLD = f"""WITH {GRADED}, r AS (SELECT c, {reason_sql(False)} AS reason FROM pairs WHERE eok),
    s AS (SELECT 'db' || (c % 5) AS db, c, CASE WHEN reason IS NULL THEN NULL WHEN c % 9 = 7 THEN 'error' ELSE 'different result' END AS why FROM r)"""


def gold(t: Tables) -> DataFrame:
    from tallygrade.plans.gold import gold_checks

    cases, rows = graded(t)
    cases = cases.filter("expected.ok").withColumn("db", F.concat(F.lit("db"), (F.col("case_id") % 5).cast("string")))
    return gold_checks(cases, compare(cases, rows, allow_extra=False))


@check("db string, ok bigint, total bigint", f"{GOLD} SELECT db, count(*) FILTER (why IS NULL) AS ok, count(*) AS total FROM s GROUP BY db")
def gold_on_two_engines(t: Tables) -> DataFrame:
    """Gold answers that stay the same on a second engine, tallied per database."""
    from tallygrade.plans.gold import verification_tally

    return verification_tally(gold(t))


@check(
    "case_id bigint, db string, reason string",
    f"""WITH {GRADED}, b AS (SELECT *, c % 3 = 1 AS as_set, list_distinct(el) AS ed, list_distinct(gl) AS gd FROM pairs WHERE eok)
    SELECT c AS case_id, 'db' || (c % 5) AS db, CASE WHEN NOT gok THEN 'error'
      WHEN gc = 3 AND NOT ecut AND NOT gcut AND CASE WHEN as_set THEN {assignments(3, 3, 'ed', 'gd')} ELSE ne = ng AND {assignments(3, 3, 'el', 'gl')} END THEN NULL
      ELSE 'different result' END AS reason FROM b""",
)
def gold_by_own_grading(t: Tables) -> DataFrame:
    """Gold answers on a second engine, each question compared by its own grading."""
    from tallygrade.plans.gold import gold_checks

    cases, rows = graded(t)
    cases = cases.filter("expected.ok").withColumn("db", F.concat(F.lit("db"), (F.col("case_id") % 5).cast("string")))
    cases = cases.withColumn("grading", parse_grading(F.when(F.col("case_id") % 3 == 1, "set")))
    return gold_checks(cases, compare(cases, rows, allow_extra=False, modes=("default", "set")))


@check("case_id bigint, db string, reason string", f"{GOLD} SELECT c AS case_id, db, why AS reason FROM s WHERE why IS NOT NULL")
def gold_that_changed(t: Tables) -> DataFrame:
    """The gold answers that do not stay the same, with the reason."""
    from tallygrade.plans.gold import failing_questions

    return failing_questions(gold(t))

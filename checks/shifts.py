"""Moved dates and numeric money, and queries run again over the moved tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.operators import shift as S
from tallygrade.operators.compare import compare
from tallygrade.sources.capture import result_rows, shapes

DAYS = -30

SHIFT_TYPES = {
    "o_orderdate": "timestamp(3)", "day": "date", "secs": "unix_seconds", "millis": "epoch_millis",
    "iso": "iso_timestamp", "day_text": "date_string", "ts_text": "timestamp_string", "span": "interval day",
    "o_totalprice": "double",
}


@check(
    "o_orderkey bigint, a string, b string, secs bigint, millis bigint, iso string, day_text string, ts_text string, price double",
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS a, strftime(d, '%Y-%m-%d') AS b, epoch(d)::BIGINT AS secs, (epoch(d) * 1000)::BIGINT AS millis,
      strftime(d, '%Y-%m-%d %H:%M:%S') AS iso, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(d, '%Y-%m-%d') END AS day_text,
      CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS ts_text, o_totalprice AS price
    FROM (SELECT *, o_orderdate - INTERVAL 30 DAY AS d FROM orders)""",
)
def shifted_columns(t: Tables) -> DataFrame:
    """Dates, timestamps, epochs and date texts moved by days; everything else as it was."""
    d = F.col("o_orderdate")
    secs = F.unix_timestamp(d.cast("timestamp"))
    table = t.orders.select(
        "o_orderkey", "o_orderdate", "o_totalprice", d.cast("date").alias("day"), secs.alias("secs"), (secs * 1000).alias("millis"),
        F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("iso"),
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("day_text"),
        F.when(F.col("o_orderkey") % 5 == 1, "").otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("ts_text"),
    )
    moved = S.shift_table(table, SHIFT_TYPES, DAYS)
    return moved.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format("day", "yyyy-MM-dd").alias("b"),
        "secs", "millis", "iso", "day_text", "ts_text", F.col("o_totalprice").alias("price"),
    )


@check(
    "o_orderkey bigint, price double, note string",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price, '$5' AS note FROM orders",
)
def money_columns(t: Tables) -> DataFrame:
    """Money texts as numbers, other columns as they were."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    table = t.orders.select("o_orderkey", text.alias("price"), F.lit("$5").alias("note"))
    return S.numeric_money(table, {"price": "money", "note": "varchar"})


@check(
    "offset_days bigint, month string, n bigint, revenue double",
    f"""SELECT d AS offset_days, strftime(o_orderdate + to_days(d), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 0) AS revenue
    FROM orders, (SELECT unnest({list(S.OFFSETS)})::INT AS d) GROUP BY ALL""",
)
def query_over_offsets(t: Tables) -> DataFrame:
    """One query text over the tables at five offsets, in one scan."""
    query = S.sql_query(t.spark, "SELECT offset_days, date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n, round(sum(o_totalprice), 0) AS revenue FROM {orders} GROUP BY 1, 2")
    return S.all_offsets({"orders": t.orders}, {"orders": {"o_orderdate": "timestamp"}}, query)


@check(
    "offset_days bigint, o_orderpriority string, n bigint, first string",
    f"""SELECT d AS offset_days, o_orderpriority, count(*) AS n, strftime(min(o_orderdate + to_days(d)), '%Y-%m-%d') AS first
    FROM orders, (SELECT unnest({list(S.OFFSETS)})::INT AS d) WHERE o_orderdate + to_days(d) BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31' GROUP BY ALL""",
)
def quarter_over_offsets(t: Tables) -> DataFrame:
    """A quarter's orders at five offsets: bounds moved back instead of the column, so that the scan can skip."""
    query = lambda tables: tables["orders"].groupBy("offset_days", "o_orderpriority").agg(F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"))
    quarter = (dt.datetime(1996, 3, 1), dt.datetime(1996, 5, 31))
    return S.all_offsets({"orders": t.orders}, {"orders": {"o_orderdate": "timestamp"}}, query, bounds={"orders": {"o_orderdate": quarter}})


@check(
    "offset_days bigint, month string, n bigint, revenue double",
    f"""SELECT d AS offset_days, strftime(o_orderdate + to_days(d), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 0) AS revenue
    FROM orders, (SELECT unnest({list(S.OFFSETS)})::INT AS d) GROUP BY ALL""",
)
def branch_per_offset(t: Tables) -> DataFrame:
    """A query text that knows nothing of offsets, run once for each."""
    query = S.sql_query(t.spark, "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n, round(sum(o_totalprice), 0) AS revenue FROM {orders} GROUP BY 1")
    return S.over_offsets({"orders": t.orders}, {"orders": {"o_orderdate": "timestamp"}}, query)


# The gold query takes the newest 90 days of the table, the generated one a fixed
# date that is the same on the unshifted data only.
NEWEST = """
days AS (SELECT unnest([0, -1, -7, -14, -30, -60])::INT AS d),
o AS (SELECT d, o_custkey, o_totalprice, o_orderpriority, o_orderdate + to_days(d) AS moved FROM orders, days),
lim AS (SELECT d, max(moved) - INTERVAL 90 DAY AS low FROM o GROUP BY d),
e AS (SELECT o.d, o_orderpriority AS p, count(*) AS n FROM o JOIN lim ON o.d = lim.d WHERE moved > low GROUP BY ALL),
g AS (SELECT d, o_orderpriority AS p, count(*) AS n FROM o WHERE moved > (SELECT low FROM lim WHERE d = 0) GROUP BY ALL),
el AS (SELECT d, list_sort(list([p, n::VARCHAR])) AS l FROM e GROUP BY d), gl AS (SELECT d, list_sort(list([p, n::VARCHAR])) AS l FROM g GROUP BY d),
s AS (SELECT days.d, coalesce(el.l, []) AS el, coalesce(gl.l, []) AS gl FROM days LEFT JOIN el USING (d) LEFT JOIN gl USING (d)),
zero AS (SELECT el AS z FROM s WHERE d = 0)
"""


def shift_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Outcome of the gold and the generated query at each offset, as cases and rows."""
    from tallygrade.session import cut

    start = t.orders.agg(F.date_format(F.max("o_orderdate") - F.make_dt_interval(F.lit(90)), "yyyy-MM-dd").alias("low"))
    schemas = {"orders": {"o_orderdate": "timestamp"}}
    gold = """SELECT o_orderpriority AS p, count(*) AS n FROM {orders}
        WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM {orders}) GROUP BY 1"""
    fixed = """SELECT count(*) AS n, o_orderpriority AS p FROM {orders}
        WHERE o_orderdate > (SELECT CAST(low AS TIMESTAMP_NTZ) FROM {start}) GROUP BY 2"""
    offsets = (0, *S.OFFSETS)
    e = S.over_offsets({"orders": t.orders}, schemas, S.sql_query(t.spark, gold), offsets)
    g = S.over_offsets({"orders": t.orders, "start": start}, schemas, S.sql_query(t.spark, fixed), offsets)
    rows = result_rows(e, F.col("offset_days"), "e", ["p", "n"]).unionByName(
        result_rows(g, F.col("offset_days"), "g", ["n", "p"])
    )
    rows = cut(rows, "shifts")
    ids = t.spark.createDataFrame([(d,) for d in offsets], "case_id int")
    return shapes(rows, ids, {"e": 2, "g": 2}), rows


STATUS = f"""WITH {NEWEST} SELECT d AS offset_days,
  CASE WHEN d = -14 THEN 'inconclusive' WHEN d = -7 THEN 'inconclusive' WHEN el = gl THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN d = -14 THEN 'shifted_generated_sql_infrastructure_error' WHEN d = -7 THEN 'shift_timed_out' END AS why,
  el <> z AS changed FROM s, zero WHERE d <> 0"""


def shift_outcomes(t: Tables) -> DataFrame:
    cases, rows = shift_inputs(t)
    compared = compare(cases, rows, allow_extra=True)
    # The gold result of each shift against the unshifted one.
    e = rows.filter(F.col("side") == "e")
    base = e.filter(F.col("case_id") == 0).select("vals")
    ids = cases.select("case_id").filter("case_id <> 0")
    # The unshifted result stands beside each offset.
    copies = base.withColumn("case_id", F.explode(F.array(*map(F.lit, S.OFFSETS))))
    against = copies.select("case_id", F.lit("e").alias("side"), F.lit(None).cast("long").alias("row_id"), "vals").unionByName(
        e.filter(F.col("case_id") != 0).withColumn("side", F.lit("g"))
    )
    changed = compare(shapes(against, ids, {"e": 2, "g": 2}), against).select("case_id", (~F.col("matched")).alias("expected_changed"))
    d = F.col("case_id")
    return compared.join(changed, "case_id").select(
        F.lit("q").alias("case_id"), d.alias("offset_days"), (d == -7).alias("timed_out"), F.lit(True).alias("expected_ok"),
        (d != -14).alias("generated_ok"), F.when(d == -14, "connection reset by peer").alias("generated_error"),
        "matched", "inconclusive", "reason", "expected_changed",
    )


@check("offset_days bigint, status string, why string, changed boolean", STATUS)
def shift_outcomes_by_offset(t: Tables) -> DataFrame:
    """Each shift passes, fails, or says nothing about the answer."""
    out = S.shift_status(shift_outcomes(t))
    why = F.when(F.col("shift_reason").startswith("shift"), F.col("shift_reason"))
    return out.select("offset_days", "status", why.alias("why"), F.col("expected_changed").alias("changed"))


@check(
    "case_id bigint, conclusive bigint, passed bigint, score double, discriminative boolean, judged bigint, overturned bigint",
    """WITH o AS (SELECT o_custkey AS c, o_orderkey, o_orderkey % 5 AS k, o_orderkey % 7 AS j FROM orders),
    s AS (SELECT *, CASE k WHEN 0 THEN 'inconclusive' WHEN 1 THEN CASE WHEN j IN (3, 4) THEN 'passed' ELSE 'failed' END ELSE 'passed' END AS status,
          k = 1 AND j > 1 AS judged, k = 1 AND j IN (3, 4) AS over FROM o)
    SELECT c AS case_id, count_if(status <> 'inconclusive') AS conclusive, count_if(status = 'passed') AS passed,
      round(count_if(status = 'passed') / nullif(count_if(status <> 'inconclusive'), 0), 4) AS score, bool_or(k = 3) AS discriminative,
      count_if(judged) AS judged, count_if(over) AS overturned FROM s GROUP BY c""",
)
def judged_shift_totals(t: Tables) -> DataFrame:
    """Totals over a case's shifts after the judge's look at the failed ones."""
    k, j = F.col("o_orderkey") % 5, F.col("o_orderkey") % 7
    o = t.orders.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("offset_days"),
        F.when(k == 0, "inconclusive").when(k == 1, "failed").otherwise("passed").alias("status"),
        F.lit(True).alias("generated_ok"), (k == 3).alias("expected_changed"), j.alias("j"),
    )
    verdicts = o.filter("j > 1").select(
        "case_id", "offset_days", (F.col("j") != 6).alias("is_false_negative"),
        F.when(F.col("j") == 2, 79).when(F.col("j") != 5, 80).alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    out = S.shift_totals(S.judged_shifts(o.drop("j"), verdicts))
    return out.select(
        "case_id", F.col("conclusive_shifts").alias("conclusive"), F.col("passed_shifts").alias("passed"),
        F.col("shift_score").alias("score"), "discriminative", F.col("shifts_judged").alias("judged"), F.col("shifts_overturned").alias("overturned"),
    )


@check(
    "case_id bigint, score double, applicable boolean, reason string",
    """WITH o AS (SELECT o_custkey AS c, count_if(o_orderkey % 3 > 0) AS n, count_if(o_orderkey % 3 = 1) AS p FROM orders GROUP BY 1),
    x AS (SELECT *, c % 10 = 0 AS no_gold, c % 10 = 1 AS gold_failed, c % 10 IN (1, 2) AS no_answer, c % 10 = 3 AS still FROM o),
    r AS (SELECT *, CASE WHEN no_gold THEN 'missing_sql' WHEN gold_failed THEN 'expected_sql_execution_failed' WHEN no_answer THEN 'missing_sql'
       WHEN still THEN 'no_temporal_columns_to_shift' WHEN n = 0 THEN 'no_conclusive_shift' END AS reason FROM x)
    SELECT c AS case_id, CASE WHEN reason IS NULL THEN round(p / n, 4) ELSE 0 END AS score,
      reason IS NULL OR (no_answer AND NOT gold_failed) AS applicable, reason FROM r""",
)
def time_shift_scores(t: Tables) -> DataFrame:
    """The time-shift result of each case with its rules of applicability."""
    k = F.col("o_orderkey") % 3
    o = t.orders.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("offset_days"),
        F.when(k == 0, "inconclusive").when(k == 1, "passed").otherwise("failed").alias("status"),
    )
    c = F.col("case_id") % 10
    cases = o.select("case_id").distinct().select(
        "case_id", F.when(c != 0, "select 1").alias("expected_sql"), F.when(~c.isin(1, 2), "select 2").alias("generated_sql"),
        (c != 1).alias("expected_ok"), (c != 3).alias("has_temporal"),
    )
    return S.time_shift_score(cases, S.shift_totals(o))


@check(
    "case_id bigint, ok boolean, sql string, engine string, raw_error string, retry boolean",
    """WITH a AS (SELECT o_custkey AS c, o_orderkey AS try, o_orderkey % 4 = 3 AS ok, 'sql ' || o_orderkey AS q,
        CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE 'connection' END AS engine,
        CASE WHEN o_orderkey % 4 <> 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'avg(money) does not exist' ELSE 'bad' END END AS err FROM orders),
    f AS (SELECT c, bool_or(ok) AS ok, coalesce(min(try) FILTER (ok), min(try)) AS used, min(try) AS first, count(*) AS n FROM a GROUP BY c)
    SELECT f.c AS case_id, f.ok, u.q AS sql, u.engine, CASE WHEN n > 1 THEN x.err END AS raw_error, coalesce(x.err LIKE '%money%', false) AS retry
    FROM f JOIN a u ON u.c = f.c AND u.try = f.used JOIN a x ON x.c = f.c AND x.try = f.first""",
)
def first_attempt_that_ran(t: Tables) -> DataFrame:
    """Which attempt of a query counts, and the first error beside it."""
    k = F.col("o_orderkey")
    ok = k % 4 == 3
    attempts = t.orders.select(
        F.col("o_custkey").alias("case_id"), k.alias("attempt"), ok.alias("ok"),
        F.concat(F.lit("sql "), k.cast("string")).alias("sql"), F.when(k % 2 == 0, "agent").otherwise("connection").alias("engine"),
        F.when(~ok, F.when(k % 3 == 0, "avg(money) does not exist").otherwise("bad")).alias("error"),
    )
    first = attempts.groupBy("case_id").agg(F.min_by("error", "attempt").alias("e"))
    out = S.first_success(attempts).join(first, "case_id")
    return out.select(
        "case_id", "ok", F.col("executed_sql").alias("sql"), "engine", "raw_error",
        S.needs_money_retry(F.col("e"), F.lit(True)).alias("retry"),
    )


@check(
    "o_orderkey bigint, error string",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'sql_execution_failure' END WHEN o_orderkey % 3 = 1 THEN 'boom' END AS error FROM orders",
)
def unfinished_agents(t: Tables) -> DataFrame:
    """The error of an agent that stopped early goes away when its SQL ran."""
    k = F.col("o_orderkey")
    error = F.when(k % 3 == 0, "sql_execution_failure").when(k % 3 == 1, "boom")
    return t.orders.select("o_orderkey", S.settle_unfinished(error, k % 2 == 0).alias("error"))

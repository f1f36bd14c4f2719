"""SQL texts: statements built from parts, in several wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.functions import statements as S
from tallygrade.operators import sqlscore
from tallygrade.operators.outcomes import dialect_validity, rewritten

GOLD = "SELECT p.p_name, SUM(p.p_size) AS total FROM part AS p WHERE p.p_brand = '%s' AND p.p_size > %s GROUP BY p.p_name ORDER BY total DESC LIMIT 5"
WORDINGS = (
    "select part.p_name, sum(part.p_size) from part where ('%s'=part.p_brand and part.p_size>%s) group by 1 order by sum(part.p_size) desc limit 5",
    "SELECT p_name AS n, SUM(p.p_size) s FROM part p WHERE p.p_brand = '%s' GROUP BY p.p_name ORDER BY s DESC LIMIT 5 -- %s",
    "SELECT x.p_name, SUM(x.p_size) AS total FROM shop.parts x WHERE x.p_brand = '%s' AND x.p_size > %s GROUP BY x.p_name ORDER BY total DESC LIMIT 5",
    "SELECT p_name FROM part WHERE p_brand = '%s' AND p_size > (SELECT %s)",
    None,
    "/* same */ select q.p_name,  sum(q.p_size) as amount\nfrom main.part q where q.p_brand = '%s' and q.p_size > %s\ngroup by q.p_name order by amount desc nulls last limit 5;",
    "SELECT p.p_name, SUM(p.weight) AS total, colour FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey WHERE p.p_brand = '%s' AND p.p_size > %s GROUP BY p.p_name ORDER BY total DESC LIMIT 5",
)


def statements(t: Tables) -> DataFrame:
    k = (F.col("p_partkey") % len(WORDINGS)).cast("int")
    size = F.col("p_size").cast("string")
    fill = lambda text: F.format_string(text.replace("%s", "%s"), F.col("p_brand"), size)
    generated = F.lit(None).cast("string")
    for i, text in enumerate(WORDINGS):
        if text:
            generated = F.when(k == i, fill(text)).otherwise(generated)
    return t.part.select(
        F.col("p_partkey").alias("case_id"), F.when(F.col("p_partkey") % 50 != 0, fill(GOLD)).alias("expected_sql"), generated.alias("generated_sql")
    )


def parsed(t: Tables) -> DataFrame:
    return sqlscore.parsed(statements(t), t.spark.sparkContext.defaultParallelism)


PARTS = f"p AS (SELECT p_partkey AS c, p_partkey % {len(WORDINGS)} AS k, lower(p_brand) AS b, p_brand AS br, p_size AS z, p_partkey % 50 = 0 AS no_gold FROM part)"


@check(
    "p_partkey bigint, text string",
    """SELECT p_partkey, 'select a, ' || lower(p_name) || ' from t where x = 1' AS text FROM part""",
)
def normalised_sql(t: Tables) -> DataFrame:
    """SQL in lower case without comments, extra space and last semicolons."""
    sql = F.concat(F.lit("SELECT  a, /* two\nlines */ "), F.upper("p_name"), F.lit("\n\tFROM t -- why\n WHERE x = 1 ;; "))
    return t.part.select("p_partkey", S.normalise_sql(sql).alias("text"))


@check(
    "case_id bigint, score double, applicable boolean, reason string",
    f"""WITH {PARTS} SELECT c AS case_id, CASE WHEN NOT no_gold AND k = 5 THEN 1.0 ELSE 0.0 END AS score, NOT no_gold AND k <> 3 AS applicable,
      CASE WHEN no_gold THEN 'no_expected_sql' WHEN k = 4 THEN 'no_generated_sql' WHEN k = 3 THEN 'not_flat' END AS reason FROM p""",
)
def sql_exact_match(t: Tables) -> DataFrame:
    """Statements that differ only in names, space, comments and NULL order are the same."""
    return sqlscore.exact_match(parsed(t))


TOKENS = """tk AS (
  SELECT c, 'e' AS side, unnest(['select', 'select', 'from', 'where', 'where', 'group', 'order', 'limit']) AS clause,
    unnest(['part.p_name', 'sum(part.p_size)', 'part', '''' || b || ''' = part.p_brand', 'part.p_size > ' || z, 'part.p_name', 'sum(part.p_size) desc', '5']) AS token
  FROM p WHERE NOT no_gold AND k NOT IN (3, 4)
  UNION ALL SELECT c, 'g', unnest(['select', 'select', 'from', 'where', 'where', 'group', 'order', 'limit']),
    unnest(['part.p_name', 'sum(part.p_size)', 'part', '''' || b || ''' = part.p_brand', 'part.p_size > ' || z, 'part.p_name', 'sum(part.p_size) desc', '5'])
  FROM p WHERE NOT no_gold AND k IN (0, 5)
  UNION ALL SELECT c, 'g', unnest(['select', 'select', 'from', 'where', 'group', 'order', 'limit']),
    unnest(['p_name', 'sum(part.p_size)', 'part', '''' || b || ''' = part.p_brand', 'part.p_name', 'sum(part.p_size) desc', '5'])
  FROM p WHERE NOT no_gold AND k = 1
  UNION ALL SELECT c, 'g', unnest(['select', 'select', 'from', 'where', 'where', 'group', 'order', 'limit']),
    unnest(['parts.p_name', 'sum(parts.p_size)', 'parts', '''' || b || ''' = parts.p_brand', 'parts.p_size > ' || z, 'parts.p_name', 'sum(parts.p_size) desc', '5'])
  FROM p WHERE NOT no_gold AND k = 2
  UNION ALL SELECT c, 'g', unnest(['select', 'select', 'select', 'from', 'from', 'join', 'where', 'where', 'group', 'order', 'limit']),
    unnest(['part.p_name', 'sum(part.weight)', 'colour', 'part', 'supplier', 'part.p_partkey = supplier.s_suppkey', '''' || b || ''' = part.p_brand', 'part.p_size > ' || z, 'part.p_name', 'sum(part.weight) desc', '5'])
  FROM p WHERE NOT no_gold AND k = 6)"""


@check("case_id bigint, side string, clause string, token string", f"WITH {PARTS}, {TOKENS} SELECT c AS case_id, side, clause, token FROM tk")
def clause_items(t: Tables) -> DataFrame:
    """The items of each clause, with aliases resolved and comparisons in one order."""
    return sqlscore.clause_items(parsed(t))


F1 = """n AS (SELECT c, clause, token, count_if(side = 'e') AS e, count_if(side = 'g') AS g FROM tk GROUP BY ALL),
f AS (SELECT c, clause, round(2 * sum(least(e, g)) / (sum(e) + sum(g)), 4) AS f1,
  coalesce(string_agg(token, '|' ORDER BY token) FILTER (e > g), '') AS missing, coalesce(string_agg(token, '|' ORDER BY token) FILTER (g > e), '') AS extra FROM n GROUP BY ALL)"""


@check("case_id bigint, clause string, f1 double, missing string, extra string", f"WITH {PARTS}, {TOKENS}, {F1} SELECT c AS case_id, clause, f1, missing, extra FROM f")
def clause_scores(t: Tables) -> DataFrame:
    """F1 of each clause with what is missing and what is extra."""
    s = sqlscore.clause_scores(sqlscore.clause_items(parsed(t)))
    return s.withColumns({c: F.concat_ws("|", c) for c in ("missing", "extra")})


@check(
    "case_id bigint, score double, applicable boolean, reason string",
    f"""WITH {PARTS}, {TOKENS}, {F1}, m AS (SELECT c, round(avg(f1), 4) AS s FROM f GROUP BY c)
    SELECT p.c AS case_id, CASE WHEN no_gold OR k IN (3, 4) THEN 0.0 ELSE s END AS score, NOT no_gold AND k <> 3 AS applicable,
      CASE WHEN no_gold THEN 'no_expected_sql' WHEN k = 4 THEN 'no_generated_sql' WHEN k = 3 THEN 'not_flat' END AS reason FROM p LEFT JOIN m ON p.c = m.c""",
)
def component_match(t: Tables) -> DataFrame:
    """The mean clause score with its rules of applicability."""
    return sqlscore.component_match(parsed(t))


def schema_of_tables(t: Tables) -> DataFrame:
    """The columns of part and supplier under bare and qualified names."""
    rows = [(f"{prefix}{n}", c) for n in ("part", "supplier") for c in getattr(t, n).columns for prefix in ("", "main.")]
    return t.spark.createDataFrame(rows, "table_key string, column string")


@check(
    "case_id bigint, score double, applicable boolean, reason string, missing_tables string, missing_columns string",
    f"""WITH {PARTS} SELECT c AS case_id, CASE WHEN k IN (0, 1, 5) THEN 1.0 ELSE 0.0 END AS score, k NOT IN (3, 4) AS applicable,
      CASE k WHEN 4 THEN 'no_generated_sql' WHEN 3 THEN 'not_flat' END AS reason, CASE k WHEN 2 THEN 'shop.parts' ELSE '' END AS missing_tables,
      CASE k WHEN 6 THEN 'colour,part.weight' ELSE '' END AS missing_columns FROM p""",
)
def schema_validity(t: Tables) -> DataFrame:
    """Only tables and columns that exist are named."""
    out = sqlscore.schema_validity(parsed(t), schema_of_tables(t))
    named = lambda k: F.coalesce(F.try_element_at("details", F.lit(k)), F.lit(""))
    return out.withColumns({k: named(k) for k in ("missing_tables", "missing_columns")})


@check(
    "case_id bigint, alias string, full_name string, known boolean",
    f"""WITH {PARTS} SELECT c AS case_id, CASE k WHEN 0 THEN 'part' WHEN 1 THEN 'p' WHEN 2 THEN 'x' WHEN 5 THEN 'q' ELSE 'p' END AS alias,
      CASE k WHEN 2 THEN 'shop.parts' WHEN 5 THEN 'main.part' ELSE 'part' END AS full_name, k <> 2 AS known FROM p WHERE k NOT IN (3, 4)
    UNION ALL SELECT c, 's', 'supplier', true FROM p WHERE k = 6""",
)
def tables_that_exist(t: Tables) -> DataFrame:
    """The tables a statement reads, looked up with and without their schema."""
    found = sqlscore.resolve_tables(sqlscore.source_tables(parsed(t)), schema_of_tables(t))
    return found.select("case_id", "alias", F.col("full").alias("full_name"), F.col("columns").isNotNull().alias("known"))


@check(
    "case_id bigint, keys string, has_order boolean",
    f"""WITH {PARTS} SELECT c AS case_id, CASE k WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN '1' WHEN 0 THEN '1' ELSE CASE WHEN k IN (2, 6) THEN '1' WHEN k = 5 THEN NULL END END AS keys,
      k NOT IN (3, 4) AS has_order FROM p""",
)
def order_key_positions(t: Tables) -> DataFrame:
    """Which result columns the ORDER BY keys are."""
    k = F.col("case_id") % len(WORDINGS)
    columns = F.when(k == 1, F.array(F.lit("n"), F.lit("S"))).when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(
        k == 6, F.array(F.lit("n"), F.lit("total"), F.lit("colour"))
    ).when(k == 5, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("p_name"), F.lit("total")))
    spread = statements(t).withColumn("columns", columns).repartition(t.spark.sparkContext.defaultParallelism, "case_id")
    parsed = S.take_apart(spread, "generated_sql", "g")
    keys = S.order_keys(F.col("g"), F.col("columns"))
    return parsed.select(
        "case_id", F.when(keys.isNotNull(), F.concat_ws(",", keys)).alias("keys"), S.has_order_by(F.col("g")).alias("has_order")
    )


@check(
    "case_id bigint, score double, applicable boolean, reason string, changed boolean",
    f"""WITH {PARTS}, e AS (SELECT *, CASE c % 4 WHEN 0 THEN 'line 1: mismatched input ''x''' WHEN 1 THEN 'relation does not exist' END AS err FROM p)
    SELECT c AS case_id, CASE WHEN k = 4 OR c % 4 = 0 OR c % 9 = 8 THEN 0.0 ELSE 1.0 END AS score, k <> 4 AS applicable,
      CASE WHEN k = 4 THEN 'no_generated_sql' WHEN c % 9 = 8 THEN 'not valid SQL: PARSE_SYNTAX_ERROR' WHEN c % 4 = 0 THEN 'rejected by the database: ' || err END AS reason,
      k <> 4 AND c % 3 = 0 AS changed FROM e""",
)
def dialect_validity_scores(t: Tables) -> DataFrame:
    """SQL that does not parse, or that the engine refused for its form, is not valid."""
    c = F.col("case_id")
    cases = statements(t).select(
        "case_id", "generated_sql",
        F.when(c % 3 == 0, F.concat(F.lit("/* x */ "), "generated_sql")).otherwise(F.col("generated_sql")).alias("executed_sql"),
        F.when(c % 9 == 8, "PARSE_SYNTAX_ERROR").alias("parse_error"), (c % 4 > 1).alias("generated_ok"),
        F.when(c % 4 == 0, "line 1: mismatched input 'x'").when(c % 4 == 1, "relation does not exist").alias("generated_error"),
    )
    out = dialect_validity(cases)
    changed = cases.select("case_id", rewritten(F.col("generated_sql"), F.col("executed_sql")).alias("changed"))
    return out.join(changed, "case_id")

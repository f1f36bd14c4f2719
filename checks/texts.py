"""Cells, names, error texts and other column functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.functions import cells as C
from tallygrade.functions import classify as K
from tallygrade.functions import figures, names
from tallygrade.functions.grading import parse_grading
from tallygrade.sources.lookups import text_date_type

ROUND = "CASE WHEN {0} = 0 THEN 0.0 ELSE CAST(format('{{:.11e}}', round({0}, 6)) AS DOUBLE) END"


@check(
    "l_orderkey bigint, l_linenumber bigint, small double, large double, negative double",
    f"""SELECT l_orderkey, l_linenumber, {ROUND.format('(l_extendedprice / 7)')} AS small,
    {ROUND.format('(l_extendedprice * 1234567.891)')} AS large, {ROUND.format('(-l_discount / 3)')} AS negative FROM lineitem""",
)
def normalised_numbers(t: Tables) -> DataFrame:
    """Six decimals, then twelve significant digits, no negative zero."""
    p = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", C.clean_number(p / 7).alias("small"),
        C.clean_number(p * 1234567.891).alias("large"), C.clean_number(-F.col("l_discount") / 3).alias("negative"),
    )


PRICE_TEXTS = """(SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_extendedprice AS p, format('{:,.2f}', l_extendedprice) AS f FROM lineitem)"""


@check(
    "l_orderkey bigint, l_linenumber bigint, number double",
    f"""SELECT l_orderkey, l_linenumber, CASE n WHEN 1 THEN p WHEN 2 THEN -p WHEN 3 THEN round(p, 2) WHEN 4 THEN NULL WHEN 5 THEN NULL
      WHEN 6 THEN p * 1000 ELSE p END AS number FROM {PRICE_TEXTS}""",
)
def numbers_in_text(t: Tables) -> DataFrame:
    """Plain, scientific, money and thousands texts; `1,2,3` and words are no numbers."""
    n, p = F.col("l_linenumber"), F.col("l_extendedprice")
    money = F.format_number(p, 2)
    text = (
        F.when(n == 1, F.concat(F.lit("$"), money))
        .when(n == 2, F.concat(F.lit("-$"), money))
        .when(n == 3, F.concat(F.lit("+"), F.replace(money, F.lit(","), F.lit(""))))
        .when(n == 4, F.lit("1,2,3"))
        .when(n == 5, F.concat(money, F.lit(" usd")))
        .when(n == 6, F.concat(F.replace(money, F.lit(","), F.lit("")), F.lit("e3")))
        .otherwise(F.concat(F.lit("€ "), money))
    )
    texts = t.lineitem.select("l_orderkey", "l_linenumber", text.alias("text"))
    number = F.round(C.parse_number(F.col("text")), 2)
    return texts.select("l_orderkey", "l_linenumber", number.alias("number"))


@check(
    "o_orderkey bigint, moment string",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d || ' 10:30:00' WHEN 3 THEN d || ' 10:30:15'
      WHEN 4 THEN d || ' 00:00:00+02:00' WHEN 5 THEN d || ' 10:30:15.250' WHEN 6 THEN d ELSE NULL END AS moment
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""",
)
def iso_moments(t: Tables) -> DataFrame:
    """ISO texts in one form: midnight is the date, seconds are filled in, other offsets stay."""
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("T00:00:00.000Z"))).when(k == 2, F.concat(d, F.lit(" 10:30")))
        .when(k == 3, F.concat(d, F.lit("T10:30:15.000+00:00"))).when(k == 4, F.concat(d, F.lit("+02:00")))
        .when(k == 5, F.concat(d, F.lit("T10:30:15.250Z"))).when(k == 6, F.concat(d, F.lit(" 00:00")))
        .otherwise(F.concat(F.lit("on "), d))
    )
    texts = t.orders.select("o_orderkey", text.alias("text"))
    return texts.select("o_orderkey", C.iso_moment(F.col("text")).alias("moment"))


@check(
    "event_id bigint, kinds string, number double, moment string, word string, missing boolean",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 't' ELSE 'n' END || 'ttn' AS kinds, CASE WHEN event_id % 5 <> 0 THEN value END AS number,
    regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.000000$', ''), ' 00:00:00$', '') AS moment,
    lower(event_type) AS word, event_id % 7 = 0 AS missing FROM events""",
)
def canonical_cells(t: Tables) -> DataFrame:
    """Cells of mixed types as tagged texts; NULL stays NULL."""
    raw = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("x "))).otherwise(F.col("value").cast("string")).alias("a"),
        F.col("ts").alias("b"),
        F.concat(F.lit("\t "), F.upper("event_type"), F.lit(" \n")).alias("c"),
        (F.col("event_id") % 2 == 0).alias("d"),
        F.when(F.col("event_id") % 7 != 0, "").alias("e"),
    )
    vals = C.with_cells(raw, ["a", "b", "c", "d", "e"])
    v = lambda i: F.col("vals")[i]
    return vals.select(
        "event_id",
        F.concat(*[F.substring(v(i), 1, 1) for i in range(4)]).alias("kinds"),
        F.when(v(0).startswith("n:"), F.substring(v(0), 3, 40)).cast("double").alias("number"),
        F.substring(v(1), 3, 40).alias("moment"),
        F.substring(v(2), 3, 40).alias("word"),
        v(4).isNull().alias("missing"),
    )


CLEAN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '{1}', 'g'), '{1}')"


@check(
    "page_id bigint, clean string, kebab string, target string",
    f"""WITH p AS (SELECT page_id, url, {CLEAN.format("url", "_")} AS c, {CLEAN.format("url", "-")} AS k,
       {CLEAN.format("'Shop DB__' || url", "-")} AS g, {CLEAN.format("substr(url, 8 + page_id % 30)", "_")} AS s FROM pages)
    SELECT page_id, CASE WHEN s = '' THEN 'column' WHEN s[1] BETWEEN '0' AND '9' THEN '_' || s ELSE s END AS clean,
    CASE WHEN k = '' THEN 'x' ELSE k END AS kebab, g AS target FROM p""",
)
def clean_names(t: Tables) -> DataFrame:
    """Field names, kebab names and target table names."""
    url = F.col("url")
    tail = F.expr("substr(url, 8 + cast(page_id % 30 as int))")
    return t.pages.select(
        "page_id", names.clean_name(tail).alias("clean"), names.kebab_name(url).alias("kebab"),
        names.target_table_name(F.lit("Shop DB"), url).alias("target"),
    )


@check(
    "doc_id bigint, key string",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents",
)
def question_keys(t: Tables) -> DataFrame:
    """Questions without case and punctuation, over whole texts."""
    return t.documents.select("doc_id", names.question_key(F.col("text")).alias("key"))


ERRORS = (
    "Connection refused by host", "HTTP 429 Too Many Requests", "line 1:8: mismatched input 'x'",
    "Function foo(bigint) does not exist", "statement timeout", "column \"x\" does not exist",
    "remaining connection slots are reserved", "quota exceeded for project", "error 5034 in row",
    "POST /a → 422: name must be unique", "RESOURCE_EXHAUSTED", "503 from upstream",
)


def _error_sql() -> str:
    return "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in ERRORS) + "]"


@check(
    "event_id bigint, infrastructure boolean, limited boolean, dialect boolean, no_slots boolean, taken boolean",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 12 THEN NULL ELSE {_error_sql()}[event_id % 13 + 1] || ' at ' || value END AS m FROM events)
    SELECT event_id,
      coalesce(regexp_matches(m, '(?i)connection refused|statement timeout|too many requests|\\b50[234]\\b|\\b429\\b'), false) AS infrastructure,
      coalesce(regexp_matches(m, '(?i)\\b429\\b|too many requests|quota exceeded|resource[ _]exhausted'), false) AS limited,
      coalesce(regexp_matches(m, '(?i)mismatched input|function .* does not exist'), false) AS dialect,
      coalesce(regexp_matches(m, 'connection slots are reserved'), false) AS no_slots,
      coalesce(regexp_matches(m, '422.*unique'), false) AS taken FROM e""",
)
def error_classes(t: Tables) -> DataFrame:
    """What an error text says: link, rate limit, dialect, connections, name."""
    picked = F.array(*[F.lit(e) for e in ERRORS])
    at = (F.col("event_id") % 13).cast("int")
    m = F.when(at != 12, F.concat(F.get(picked, at), F.lit(" at "), F.col("value").cast("string")))
    e = t.events.select("event_id", m.alias("m"))
    m = F.col("m")
    return e.select(
        "event_id", K.is_infrastructure_error(m).alias("infrastructure"), K.is_rate_limit(m).alias("limited"),
        K.is_dialect_error(m).alias("dialect"), K.is_out_of_connections(m).alias("no_slots"), K.is_name_taken(m).alias("taken"),
    )


TYPES = ("date", "timestamp(3)", "TIMESTAMP with time zone", "time", "time(6)", "interval day", "unix_seconds",
         "epoch_millis", "varchar", "bigint", "date_string", "datetime", "timestamp_string", "money")
TEMPORAL = (1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 1, 1, 1, 0)


@check(
    "p_partkey bigint, db_type string, temporal boolean, money boolean",
    f"""SELECT p_partkey, {list(TYPES)}[p_partkey % 14 + 1] AS db_type, {list(TEMPORAL)}[p_partkey % 14 + 1] = 1 AS temporal, p_partkey % 14 = 13 AS money FROM part""",
)
def temporal_types(t: Tables) -> DataFrame:
    """Type names that hold a calendar moment, and money."""
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % 14).cast("int"))
    typed = t.part.select("p_partkey", kind.alias("db_type"))
    return typed.select(
        "p_partkey", "db_type", K.is_temporal_type(F.col("db_type")).alias("temporal"), K.is_money_type(F.col("db_type")).alias("money")
    )


METHODS = ("set", " Multiset ", "LIST", "subset", "subset,=,3", "subset , >= , 2", "subset,<,3", "", "unordered")


@check(
    "c_custkey bigint, mode string, op string, n bigint",
    f"""SELECT c_custkey, ['set', 'multiset', 'list', 'subset', 'subset', 'subset', 'default', 'default', 'default', 'default'][i] AS mode,
      [NULL, NULL, NULL, NULL, '=', '>=', NULL, NULL, NULL, NULL][i] AS op, [NULL, NULL, NULL, NULL, 3, 2, NULL, NULL, NULL, NULL][i] AS n
    FROM (SELECT c_custkey, c_custkey % 10 + 1 AS i FROM customer)""",
)
def grading_methods(t: Tables) -> DataFrame:
    """Grading texts as mode, operator and count."""
    text = F.get(F.array(*map(F.lit, METHODS)), (F.col("c_custkey") % 10).cast("int"))
    g = t.customer.select("c_custkey", parse_grading(text).alias("g"))
    return g.select("c_custkey", "g.mode", "g.op", F.col("g.count").alias("n"))


@check(
    "c_custkey bigint, catalog string, covered boolean, dialect string",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sales' WHEN 1 THEN 'stock' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'rest' END END AS catalog,
      c_custkey % 4 < 2 OR c_custkey % 3 = 0 AS covered, ['postgres', 'databricks', 'mysql', NULL, 'tsql'][c_custkey % 5 + 1] AS dialect FROM customer""",
)
def catalogs_and_dialects(t: Tables) -> DataFrame:
    """The catalog of a connection from its map text, and dialect names."""
    c = F.col("c_custkey")
    m = figures.catalog_map(F.lit(" 0 = sales, 1=stock ,"))
    found = figures.catalog_for(m, c % 4, F.when(c % 3 == 0, "rest").otherwise(""))
    name = F.get(F.array(*map(F.lit, ("PostgreSQL", "spark", "mariadb", "none", "MSSQL"))), (c % 5).cast("int"))
    return t.customer.select(
        "c_custkey", found.alias("catalog"), found.isNotNull().alias("covered"), figures.dialect_of(name).alias("dialect")
    )


@check(
    "o_orderkey bigint, type string",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'date_string' WHEN 1 THEN 'timestamp_string' WHEN 2 THEN 'varchar' WHEN 3 THEN 'date_string'
      WHEN 4 THEN 'varchar' ELSE 'bigint' END AS type FROM orders""",
)
def text_date_types(t: Tables) -> DataFrame:
    """Text columns that hold dates, by examples, meaning or name."""
    k, d = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    examples = (
        F.when(k == 0, F.array(d, F.concat(F.lit(" "), d)))
        .when(k == 1, F.array(d, F.concat(d, F.lit(" 10:30"))))
        .when(k == 2, F.array(d, F.lit("n/a")))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    db_type = F.when(k == 5, "BIGINT").when(k == 3, "").otherwise("VarChar")
    name = F.when(k == 3, "order_date").when(k == 4, "updated").otherwise("x")
    return t.orders.select(
        "o_orderkey", text_date_type(db_type, examples, F.lit(None).cast("string"), name).alias("type")
    )

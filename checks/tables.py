"""Loading tables: types, values, names, keys, batches and load plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.session import shared_folder
from tallygrade.sources import batches as B
from tallygrade.sources import capture, lookups
from tallygrade.sources import tables as T


def parts_by_size(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts of each size as one result: raw cells in key order, and its shape."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    k = F.col("p_partkey")
    rows = t.part.select(
        F.col("p_size").alias("case_id"), F.lit("e").alias("side"), (F.row_number().over(w) - 1).alias("row_id"),
        F.array(k.cast("string"), F.repeat(F.concat("p_name", F.lit(" ")), 9), F.when(k % 3 != 0, F.col("p_brand"))).alias("vals"),
    )
    shapes = rows.groupBy("case_id").agg(F.count("*").alias("n_rows")).select(
        "case_id", F.lit("e").alias("side"), F.lit(True).alias("ok"), F.array(*map(F.lit, ("key", "name", "brand"))).alias("columns"),
        "n_rows", F.lit(False).alias("cut"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("error"),
    )
    return rows, shapes


# ---------------------------------------------------------------- types

def text_table(t: Tables) -> DataFrame:
    """Customers with every column as text; one column has a word among its numbers."""
    c = F.col("c_custkey")
    return t.customer.select(
        c.cast("string").alias("id"), F.col("c_acctbal").cast("string").alias("balance"),
        F.when(c == 7, "n/a").otherwise(c.cast("string")).alias("badge"), F.col("c_name").alias("name"),
        F.when(c % 2 == 0, c.cast("string")).alias("half"), F.lit("2020-01-01").alias("opened"), F.lit(None).cast("string").alias("nothing"),
    )


@check(
    "column string, kind string",
    """WITH x AS (SELECT c_custkey::VARCHAR AS id, c_acctbal::VARCHAR AS balance, CASE WHEN c_custkey = 7 THEN 'n/a' ELSE c_custkey::VARCHAR END AS badge, c_name AS name,
      CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS half FROM customer),
    i AS (SELECT bool_and(id IS NULL OR TRY_CAST(id AS BIGINT) IS NOT NULL) AS a, bool_and(TRY_CAST(balance AS DOUBLE) IS NOT NULL) AS b,
      bool_and(TRY_CAST(badge AS DOUBLE) IS NOT NULL) AS c, bool_and(half IS NULL OR TRY_CAST(half AS BIGINT) IS NOT NULL) AS d FROM x)
    SELECT u.* FROM i, (VALUES ('id', 1), ('balance', 2), ('badge', 3), ('name', 4), ('half', 5), ('opened', 6), ('nothing', 7)) AS v(n, k),
      LATERAL (SELECT n AS "column", CASE k WHEN 1 THEN CASE WHEN a THEN 'bigint' ELSE 'text' END WHEN 2 THEN CASE WHEN b THEN 'double' ELSE 'text' END
        WHEN 3 THEN CASE WHEN c THEN 'bigint' ELSE 'text' END WHEN 5 THEN CASE WHEN d THEN 'bigint' ELSE 'text' END WHEN 7 THEN 'bigint' ELSE 'text' END AS kind) u""".replace('"column"', "col").replace("u.*", "u.col AS \"column\", u.kind"),
)
def inferred_kinds(t: Tables) -> DataFrame:
    """The narrowest kind all values of a column fit; dates stay text."""
    declared = {"id": "bigint", "balance": "double", "badge": "bigint", "half": "bigint", "name": "text", "opened": "text", "nothing": "bigint"}
    return T.infer_kinds(text_table(t), declared)


DECLARED = ("INTEGER", "bigint unsigned", "REAL", "float(8)", "DOUBLE PRECISION", "NUMERIC(10,2)", "decimal", "BLOB", "DATE", "varchar(9)", "")


@check(
    "p_partkey bigint, kind string",
    f"""SELECT p_partkey, ['bigint', 'bigint', 'double', 'double', 'double', 'double', 'double', 'binary', 'text', 'text', 'text', 'text'][p_partkey % 12 + 1] AS kind FROM part""",
)
def declared_kinds(t: Tables) -> DataFrame:
    """Kinds of declared column types."""
    d = F.get(F.array(*map(F.lit, DECLARED)), (F.col("p_partkey") % 12).cast("int"))
    return t.part.select("p_partkey", T.declared_kind(d).alias("kind"))


@check(
    "tbl string, col string, kind string",
    """SELECT 'part' || p_partkey AS tbl, 'c' || i AS col, ['bigint', 'double', 'binary', 'text'][(p_partkey + i) % 4 + 1] AS kind FROM part, (SELECT unnest([0, 1, 2]) AS i)""",
)
def kinds_from_schema_file(t: Tables) -> DataFrame:
    """Column kinds given by a schema document."""
    kinds = F.array(*map(F.lit, ("bigint", "double", "varbinary", "date")))
    column = lambda i: F.struct(F.lit(f"c{i}").alias("name"), F.get(kinds, ((F.col("p_partkey") + i) % 4).cast("int")).alias("trino_type"))
    raw = t.part.select(F.array(F.struct(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.array(*[column(i) for i in range(3)]).alias("columns")
    )).alias("tables"))
    return T.kinds_of_schema(raw).toDF("tbl", "col", "kind")


@check(
    "event_id bigint, n bigint, d double, b string, s string",
    """SELECT event_id, event_id AS n, CASE WHEN event_id % 3 <> 0 THEN value END AS d, base64(encode(event_type)) AS b, event_type || event_id AS s FROM events""",
)
def converted_values(t: Tables) -> DataFrame:
    """Values as their kind, ready to be sent: blobs as base64, no NaN, no NUL characters."""
    k = F.col("event_id") % 3
    raw = t.events.select(
        "event_id", F.col("event_id").cast("string").alias("n"),
        F.when(k == 0, float("nan")).otherwise(F.col("value")).alias("d"),
        F.encode("event_type", "UTF-8").alias("b"),
        F.encode(F.concat("event_type", F.lit("\x00"), F.col("event_id").cast("string")), "UTF-8").alias("s"),
    )
    kinds = {"event_id": "bigint", "n": "bigint", "d": "double", "b": "binary", "s": "text"}
    typed = T.as_kinds(raw, kinds)
    return typed.select(*[T.sendable(F.col(c), k).alias(c) for c, k in kinds.items()])


@check("n bigint, seen bigint, names string", "SELECT count(*) AS n, count(*) AS seen, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS names FROM customer")
def loaded_table(t: Tables) -> DataFrame:
    """A table written with lower-case names, counted while it is written."""
    upper = t.customer.toDF(*[c.upper() for c in t.customer.columns])
    path = f"{shared_folder(t.spark)}/load-{uuid.uuid4().hex}"
    loaded, seen = T.write_table(upper, path, "Customer")
    return loaded.agg(
        F.count("*").alias("n"), F.lit(seen.get["rows"]).alias("seen"), F.lit(",".join(sorted(loaded.columns))).alias("names")
    )


@check(
    "db_id string, path string",
    """WITH f AS (SELECT CASE page_id % 4 WHEN 0 THEN 'db' || page_id || '.parquet' WHEN 1 THEN 'db' || page_id - 1 || '/db' || page_id - 1 || '.parquet'
        WHEN 2 THEN 'db' || page_id || '/db' || page_id || '.parquet' ELSE 'db' || page_id || '/other.parquet' END AS path FROM pages),
    d AS (SELECT path, regexp_extract(path, '([^/]+)\\.parquet$', 1) AS db_id, contains(path, '/') AS deep FROM f WHERE NOT contains(path, 'other'))
    SELECT db_id, arg_min(path, deep::INT) AS path FROM d GROUP BY db_id""",
)
def found_databases(t: Tables) -> DataFrame:
    """Databases among file paths; the flat file wins over the one in a folder."""
    p, k = F.col("page_id"), F.col("page_id") % 4
    db = lambda n: F.concat(F.lit("db"), n.cast("string"))
    ext = F.lit(".parquet")
    path = (
        F.when(k == 0, F.concat(db(p), ext)).when(k == 1, F.concat(db(p - 1), F.lit("/"), db(p - 1), ext))
        .when(k == 2, F.concat(db(p), F.lit("/"), db(p), ext)).otherwise(F.concat(db(p), F.lit("/other"), ext))
    )
    return T.find_databases(t.pages.select(path.alias("path")))


@check("db_id string", "SELECT unnest(['customer', 'part', 'orders']) AS db_id FROM region LIMIT 3")
def listed_files(t: Tables) -> DataFrame:
    """Databases found in a folder without reading the files."""
    found = T.find_databases(T.list_files(t.spark, t.folder))
    return found.filter(F.col("db_id").isin("customer", "part", "orders")).select("db_id")


# ---------------------------------------------------------------- names and keys

@check(
    "source string, doc_id bigint, field string",
    """WITH RECURSIVE c AS (SELECT source, doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '_2' ELSE lang END AS clean, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    r AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used FROM c
      UNION ALL SELECT r.source, c.i, list_append(used, CASE WHEN NOT list_contains(used, clean) THEN clean
        ELSE clean || '_' || list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(used, clean || '_' || n))[1] END) FROM r JOIN c ON c.source = r.source AND c.i = r.i + 1)
    SELECT c.source, c.doc_id, used[len(used)] AS field FROM r JOIN c ON c.source = r.source AND c.i = r.i""",
)
def unique_field_names(t: Tables) -> DataFrame:
    """Clean names made unique in the order the columns come."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.upper("lang")).when(k == 1, F.concat("lang", F.lit("_2"))).otherwise(F.concat("lang", F.lit(" !")))
    named = t.documents.select("source", "doc_id", name.alias("name"))
    return T.unique_names(named, ["source"], "doc_id", "name", "field")


@check(
    "l_orderkey bigint, l_linenumber bigint, n bigint",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(t: Tables) -> DataFrame:
    """Key values that occur more than once."""
    return T.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@check(
    "o_orderkey bigint, o_custkey bigint",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 3 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
)
def orphan_references(t: Tables) -> DataFrame:
    """Rows whose reference has no parent; NULL references are skipped."""
    child = t.orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 10 != 3, F.col("o_custkey")))
    return T.orphans(child, ["o_custkey"], t.customer.filter("c_nationkey < 20"), ["c_custkey"])


@check(
    "tbl string, target string, n bigint, kinds string, field string",
    """WITH c AS (SELECT source, lang, doc_id, n_chars % 3 AS k FROM documents)
    SELECT 'T ' || source AS tbl, 'shop-t-' || source AS target, count(DISTINCT 'col ' || doc_id) AS n,
      string_agg(['bigint', 'text', 'double'][k + 1], ',' ORDER BY doc_id) AS kinds, 'col_' || min(doc_id) || ' ' || ['long', 'string', 'double'][arg_min(k, doc_id) + 1] AS field FROM c GROUP BY source""",
)
def load_plans(t: Tables) -> DataFrame:
    """One plan per table: target name, renamed columns, kinds and fields."""
    k = F.col("n_chars") % 3
    columns = t.documents.select(
        F.concat(F.lit("T "), "source").alias("table"), F.col("doc_id").alias("pos"),
        F.concat(F.lit("col "), F.col("doc_id").cast("string")).alias("column"),
        F.when(k == 0, "bigint").when(k == 1, "text").otherwise("double").alias("kind"),
    )
    p = T.load_plan(columns, "Shop")
    first = lambda path: F.get_json_object("fields", path)
    return p.select(
        F.col("table").alias("tbl"), "target", F.size("columns").alias("n"), F.concat_ws(",", "kinds").alias("kinds"),
        F.concat_ws(" ", first("$[0].name"), first("$[0].type[1]")).alias("field"),
    )


# ---------------------------------------------------------------- batches

@check(
    "event_type string, event_id bigint, row_idx bigint, batch bigint",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx,
    (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS batch FROM events""",
)
def fixed_batches(t: Tables) -> DataFrame:
    """Rows numbered per table and cut into batches of fixed size."""
    rows = B.numbered_rows(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], F.floor(F.col("event_id") / 100))
    return B.fixed_batches(rows, ["event_type"], "row_idx", 50)


@check(
    "source string, doc_id bigint, batch bigint",
    """WITH RECURSIVE j AS (SELECT source, doc_id, strlen(CAST(to_json({'doc_id': doc_id, 'text': text, 'lang': lang}) AS VARCHAR)) + 2 AS size FROM documents),
    d AS (SELECT source, doc_id, row_number() OVER w - 1 AS i, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS filled
      FROM j WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    x AS (SELECT a.source, a.i, coalesce(max(b.i + 1) FILTER (b.upto - a.filled <= 6000 - 2), a.i + 1) AS after FROM d a JOIN d b ON a.source = b.source AND b.i BETWEEN a.i AND a.i + 2 GROUP BY a.source, a.i),
    c AS (SELECT source, 0 AS i, 0 AS batch FROM d WHERE i = 0 UNION ALL SELECT c.source, x.after, batch + 1 FROM c JOIN x ON c.source = x.source AND c.i = x.i)
    SELECT d.source, doc_id, batch FROM d ASOF JOIN c ON d.source = c.source AND d.i >= c.i""",
)
def sized_batches(t: Tables) -> DataFrame:
    """Batches of at most three rows and 6000 bytes, greedy over the whole table of each source."""
    d = t.documents.withColumn("_size", B.json_bytes("doc_id", "text", "lang"))
    rows = B.numbered_rows(d, ["source"], ["doc_id"], F.floor(F.col("doc_id") / 500))
    return B.sized_batches(rows, ["source"], "row_idx", "_size", 3, 6_000)


STATE = "s AS (SELECT * FROM (VALUES ('click', 40, false), ('view', 10, true), ('error', 0, false)) AS v(event_type, pushed, done))"


def load_state(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("click", 40, False), ("view", 10, True), ("error", 0, False)], "event_type string, pushed_rows int, done boolean")


@check(
    "event_type string, event_id bigint",
    f"""WITH {STATE}, n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
    SELECT event_type, event_id FROM n LEFT JOIN s USING (event_type) WHERE NOT coalesce(done, false) AND i >= coalesce(pushed, 0)""",
)
def rows_not_sent_yet(t: Tables) -> DataFrame:
    """A load that goes on after the rows already sent."""
    rows = B.numbered_rows(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], F.floor(F.col("event_id") / 100))
    return B.pending_rows(rows, load_state(t), "event_type", "row_idx")


@check(
    "event_type string, event_id bigint, user_id bigint",
    """WITH s AS (SELECT * FROM (VALUES ('click', 400, false), ('view', 10, true), ('error', NULL, false)) AS v(event_type, last, done))
    SELECT event_type, event_id, user_id FROM events LEFT JOIN s USING (event_type) WHERE NOT coalesce(done, false) AND event_id > coalesce(last, -1)""",
)
def rows_behind_bound(t: Tables) -> DataFrame:
    """A load that goes on behind the last row sent of each table, without numbering it again."""
    state = t.spark.createDataFrame([("click", 400, False), ("view", 10, True), ("error", None, False)], "event_type string, last long, done boolean")
    return B.rows_behind(t.events.select("event_type", "event_id", "user_id"), state, "event_type", "event_id")


@check(
    "event_type string, total_rows bigint, pushed_rows bigint, done boolean",
    f"WITH {STATE} SELECT event_type, count(*) AS total_rows, any_value(coalesce(pushed, 0)) AS pushed_rows, bool_or(coalesce(done, false)) AS done FROM events LEFT JOIN s USING (event_type) GROUP BY 1",
)
def load_progress(t: Tables) -> DataFrame:
    """Rows per table, rows sent and whether the table is done."""
    return B.load_progress(t.events, load_state(t), "event_type")


# ---------------------------------------------------------------- capture

@check(
    "case_id string, ok boolean, n_rows bigint, cut boolean, total bigint, failed boolean",
    """SELECT 'all' AS case_id, true AS ok, 25 AS n_rows, false AS cut, NULL AS total, false AS failed FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'cut', true, 100, true, (SELECT count(*) FROM orders), false FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'bad', false, NULL, false, NULL, true FROM region WHERE r_regionkey = 0""",
)
def captured_results(t: Tables) -> DataFrame:
    """Queries run and kept with their shape: whole, cut at the cap, or failed."""
    runs = {
        "all": lambda spark: t.nation.orderBy("n_nationkey"),
        "cut": lambda spark: t.orders.orderBy("o_orderkey"),
        "bad": lambda spark: t.orders.select("no_such_column"),
    }
    shapes = None
    for name, run in runs.items():
        _, shape = capture.capture(t.spark, run, name, "e", max_rows=100, count_cut=True)
        shapes = shape if shapes is None else shapes.unionByName(shape)
    return shapes.withColumn("failed", F.col("error").isNotNull())


@check(
    "row_id bigint, orderkey double, status string",
    "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_id, o_orderkey AS orderkey, lower(o_orderstatus) AS status FROM orders",
)
def captured_positions(t: Tables) -> DataFrame:
    """Every row of a captured result keeps its place in the query's order."""
    ordered = lambda spark: t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderstatus")
    rows, _ = capture.capture(t.spark, ordered, "q", "e")
    return rows.select(
        "row_id", F.substring(F.col("vals")[0], 3, 30).cast("double").alias("orderkey"), F.substring(F.col("vals")[1], 3, 30).alias("status")
    )


@check(
    "o_custkey bigint, cells string, doubled boolean",
    "SELECT o_custkey, o_orderkey || ',-,' || o_orderstatus AS cells, o_custkey % 2 = 0 AS doubled FROM orders",
)
def objects_in_column_order(t: Tables) -> DataFrame:
    """Rows that came as objects, put in column order; double names are reported."""
    names = F.when(F.col("o_custkey") % 2 == 0, F.array(*map(F.lit, ("k", "x", "s", "s")))).otherwise(F.array(*map(F.lit, ("k", "x", "s"))))
    rows = F.to_json(F.array(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k"))))
    cells, doubled = capture.objects_in_order(names, rows)
    shown = F.array_join(F.slice(F.get(cells, 0), 1, 3), ",", "-")
    return t.orders.select("o_custkey", shown.alias("cells"), doubled.alias("doubled"))


@check("c0 bigint, c1 string, c2 double", "SELECT p_partkey AS c0, p_name AS c1, p_retailprice AS c2 FROM part")
def bare_results(t: Tables) -> DataFrame:
    """A result that came without names."""
    rows = t.part.select("p_partkey", "p_name", "p_retailprice")
    return rows.toDF(*capture.bare_names(len(rows.columns)))


# ---------------------------------------------------------------- lookups and schema maps

@check(
    "key string, value string",
    """SELECT 'p' || p_partkey AS key, p_brand AS value FROM part UNION ALL SELECT 'q' || p_partkey, p_brand FROM part WHERE p_partkey % 3 = 2""",
)
def lookup_entries(t: Tables) -> DataFrame:
    """A lookup read from an object, from pairs, and from objects with a token field."""
    k = F.col("p_partkey")
    key, other = F.concat(F.lit("p"), k.cast("string")), F.concat(F.lit("q"), k.cast("string"))
    body = (
        F.when(k % 3 == 0, F.to_json(F.create_map(key, F.concat(F.lit(" "), "p_brand"))))
        .when(k % 3 == 1, F.to_json(F.array(F.array(key, F.col("p_brand")))))
        .otherwise(F.to_json(F.array(F.struct(F.col("p_brand").alias("Access-Token"), key.alias("id"), other.alias("name")))))
    )
    return lookups.lookup_entries(t.part.select(body.alias("body")))


@check("key string, n_values bigint", "SELECT p_brand AS key, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def conflicting_lookup_keys(t: Tables) -> DataFrame:
    """Keys of a lookup that have more than one value."""
    return lookups.conflicting_keys(t.part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("value")))


@check("key string, value string", "SELECT p_brand AS key, 'v' || p_brand AS value FROM part GROUP BY 1")
def settled_lookups(t: Tables) -> DataFrame:
    """One value per key, or the job fails."""
    return lookups.settled_lookup(t.part.select(F.col("p_brand").alias("key"), F.concat(F.lit("v"), "p_brand").alias("value")))


CATALOG = """c AS (SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN '' ELSE upper(lang) END AS s, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Cat' END AS cat,
   source AS t, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'Col' || doc_id % 4 END AS col, 'type' || n_chars % 7 AS type FROM documents),
k AS (SELECT t AS table_key, col, type, seq FROM c WHERE trim(col) <> '' UNION ALL SELECT lower(s) || '.' || t, col, type, seq FROM c WHERE trim(col) <> '' AND s <> ''
  UNION ALL SELECT lower(cat) || '.' || lower(s) || '.' || t, col, type, seq FROM c WHERE trim(col) <> '' AND s <> '' AND cat <> ''),
sc AS (SELECT table_key, col, arg_max(type, seq) AS type FROM k GROUP BY ALL)"""


def catalog(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("seq"), F.when(d % 5 != 0, F.upper("lang")).otherwise("").alias("schema"), F.when(d % 3 != 0, "Cat").alias("catalog"),
        F.concat(F.lit(" "), F.upper("source")).alias("table"),
        F.when(d % 11 == 0, " ").otherwise(F.concat(F.lit("Col"), (d % 4).cast("string"))).alias("column_name"),
        F.concat(F.lit("type"), (F.col("n_chars") % 7).cast("string")).alias("type"),
    )


@check("table_key string, columns string", f"WITH {CATALOG} SELECT table_key, string_agg(col || ' ' || type, ',' ORDER BY col) AS columns FROM sc GROUP BY 1")
def schema_maps(t: Tables) -> DataFrame:
    """A catalog scan as table keys with their columns; the last type wins."""
    m = lookups.schema_map(lookups.schema_columns(catalog(t)))
    text = F.array_join(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ",")
    return m.select("table_key", text.alias("columns"))


@check(
    "ref bigint, table_key string",
    f"""WITH {CATALOG}, keys AS (SELECT DISTINCT table_key FROM sc),
    r AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'CAT' ELSE '' END AS c, ['en', 'DE', '', 'xx'][p_partkey % 4 + 1] AS s, 'src' || p_size AS t FROM part)
    SELECT ref, coalesce((SELECT table_key FROM keys WHERE c <> '' AND s <> '' AND table_key = lower(c) || '.' || lower(s) || '.' || t),
      (SELECT table_key FROM keys WHERE s <> '' AND table_key = lower(s) || '.' || t), (SELECT table_key FROM keys WHERE table_key = t)) AS table_key FROM r""",
)
def most_specific_table(t: Tables) -> DataFrame:
    """The most specific schema key each table reference finds."""
    p = F.col("p_partkey")
    refs = t.part.select(
        p.alias("ref"), F.when(p % 2 == 0, "CAT").alias("catalog"), F.get(F.array(*map(F.lit, ("en", "DE", "", "xx"))), (p % 4).cast("int")).alias("schema"),
        F.concat(F.lit("SRC"), F.col("p_size").cast("string")).alias("table"),
    )
    return lookups.lookup_tables(refs, lookups.schema_columns(catalog(t)))


@check(
    "column string, type string",
    """SELECT unnest(['day', 'moment', 'mixed']) AS "column", unnest(['date_string', 'timestamp_string', 'varchar']) AS type FROM region WHERE r_regionkey = 0""",
)
def profiled_text_columns(t: Tables) -> DataFrame:
    """Text columns that hold dates, judged over all their values."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 9
    texts = t.orders.select(
        F.when(k != 0, d).alias("day"), F.when(k == 1, F.concat(d, F.lit(" 10:00"))).otherwise(d).alias("moment"),
        F.when(k == 1, "soon").otherwise(d).alias("mixed"),
    )
    return lookups.profile_text_columns(texts, ["day", "moment", "mixed"])

"""Question sets: documents and benchmark passages as questions of databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.plans.evaluators import QuestionSource, QuestionSources
from tallygrade.sources import questions as Q
from tallygrade.sources import sinks

PY_SPACE = r"[\s]"
TRIM = "regexp_replace(regexp_replace({0}, '^[\\s]+', ''), '[\\s]+$', '')"


def questions(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        d.cast("int").alias("question_id"), F.col("source").alias("db_id"), F.concat(F.lit("\n "), F.col("text")).alias("question"),
        F.when(d % 3 == 0, F.concat(F.lit(" use "), F.col("lang"), F.lit(" "))).when(d % 3 == 1, " ").alias("evidence"),
        F.concat(F.lit(" SELECT "), d.cast("string"), F.lit(" \n")).alias("SQL"),
        F.when(d % 4 == 0, " set ").alias("grading_method"),
    )


@check(
    "id string, query string, expected_sql string, grading string, evidence string",
    f"""SELECT 'bird-' || doc_id AS id, {TRIM.format('text')} || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Hint: use ' || lang ELSE '' END AS query,
    'SELECT ' || doc_id AS expected_sql, CASE WHEN doc_id % 4 = 0 THEN 'set' ELSE '' END AS grading, CASE WHEN doc_id % 3 = 0 THEN 'use ' || lang ELSE '' END AS evidence FROM documents""",
)
def question_items(t: Tables) -> DataFrame:
    """Question rows as dataset items with their hint."""
    items = Q.to_items(questions(t))
    m = F.col("metadata")
    return items.select("id", "query", "expected_sql", m["grading_method"].alias("grading"), m["evidence"].alias("evidence"))


def raw_items(t: Tables) -> DataFrame:
    d, k = F.col("doc_id"), F.col("doc_id") % 5
    return t.documents.select(
        F.concat(F.lit("i"), d.cast("string")).alias("id"),
        F.struct(F.when(k == 0, "").when(k != 1, F.col("text")).alias("query")).alias("input"),
        F.struct(F.when(d % 2 == 0, "select 1").otherwise("").alias("sql"), F.when(d % 3 == 0, "select 2").alias("response")).alias("expected_output"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )


@check(
    "id string, query string, expected_sql string, reason string",
    """SELECT 'i' || doc_id AS id, CASE WHEN k > 1 THEN text END AS query,
      CASE WHEN k > 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'select 1' WHEN doc_id % 3 = 0 THEN 'select 2' ELSE '' END END AS expected_sql,
      CASE WHEN k <= 1 THEN 'Dataset item ''i' || doc_id || ''' missing required field: input.query' END AS reason FROM (SELECT *, doc_id % 5 AS k FROM documents)""",
)
def parsed_items(t: Tables) -> DataFrame:
    """Items with a query, and the rejected ones with the reason."""
    items, rejected = Q.parse_items(raw_items(t))
    none = F.lit(None).cast("string")
    return items.select("id", "query", "expected_sql", none.alias("reason")).unionByName(
        rejected.select("id", none.alias("query"), none.alias("expected_sql"), "reason")
    )


@check("question_id bigint, db_id string, length bigint", "SELECT doc_id AS question_id, source AS db_id, length(text) + 2 AS length FROM documents")
def questions_from_json_lines(t: Tables) -> DataFrame:
    """Questions written as JSON lines and read back with their schema."""
    import uuid

    from tallygrade.session import shared_folder

    path = f"{shared_folder(t.spark)}/questions-{uuid.uuid4().hex}"
    sinks.write_questions(questions(t), path)
    read = Q.read_questions(t.spark, path)
    return read.select("question_id", "db_id", F.length("question").alias("length"))


@check("db_id string", "SELECT DISTINCT source AS db_id FROM documents")
def database_ids(t: Tables) -> DataFrame:
    """Distinct database ids in order."""
    return Q.database_ids(questions(t))


@check("question_id bigint", "SELECT doc_id AS question_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def only_given_questions(t: Tables) -> DataFrame:
    """Only the questions with a given id."""
    ids = t.labels.filter("quality = 1").select(F.col("doc_id").cast("int").alias("question_id"))
    return Q.only_ids(questions(t), ids, "question_id")


@check("question_id bigint", "SELECT doc_id AS question_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 25")
def page_of_questions(t: Tables) -> DataFrame:
    """A part of the questions by offset and limit."""
    return Q.page(questions(t), "question_id", 25, 50)


VOTES = """e AS (SELECT 'postgres' AS engine, source AS db_id, doc_id AS id FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'trino', source, doc_id FROM documents WHERE doc_id % 3 = 0 AND source <> 'src3'
  UNION ALL SELECT 'pushed', source, doc_id FROM documents WHERE doc_id % 7 = 0)"""


def votes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    engines = F.array_compact(F.array(
        F.when(d % 2 == 0, "postgres"), F.when((d % 3 == 0) & (F.col("source") != "src3"), "trino"), F.when(d % 7 == 0, "pushed")
    ))
    return t.documents.select(F.explode(engines).alias("engine"), F.col("source").alias("db_id"), d.cast("int").alias("id"))


@check(
    "layout string, db_id string, id bigint",
    f"""WITH {VOTES}, n AS (SELECT db_id, count(DISTINCT engine) AS all_n FROM e WHERE engine <> 'pushed' GROUP BY 1)
    SELECT 'loaded' AS layout, db_id, id FROM (SELECT db_id, id, count(DISTINCT engine) AS v FROM e WHERE engine <> 'pushed' GROUP BY ALL) JOIN n USING (db_id) WHERE v = all_n
    UNION ALL SELECT 'pushed', db_id, id FROM e WHERE engine = 'pushed'""",
)
def verified_on_every_engine(t: Tables) -> DataFrame:
    """Questions verified on every engine that lists their database."""
    v = votes(t)
    return Q.verified_ids(v).withColumn("layout", F.lit("loaded")).unionByName(
        Q.verified_ids(v, pushed=True).withColumn("layout", F.lit("pushed"))
    )


@check(
    "question_id bigint, db_id string",
    "SELECT doc_id AS question_id, source AS db_id FROM documents WHERE source NOT IN ('src1', 'src2') OR (source = 'src1' AND doc_id % 2 = 0)",
)
def verified_questions_only(t: Tables) -> DataFrame:
    """Listed databases keep their verified questions, other databases all."""
    q = questions(t)
    verified = q.filter("db_id = 'src1' AND question_id % 2 = 0").select("db_id", F.col("question_id").alias("id"))
    listed = q.filter("db_id IN ('src1', 'src2')").select("db_id").distinct()
    return Q.with_verified(q, verified, listed)


@check(
    "name string, dataset string, reason string",
    """WITH c AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'src' || c_custkey % 30 WHEN 1 THEN 'BIRD-src' || c_custkey % 30 WHEN 2 THEN 'bird databases'
        WHEN 3 THEN 'Sales ' || c_custkey END AS name, c_custkey % 30 < 20 AS known, c_custkey % 5 AS k FROM customer)
    SELECT name, CASE WHEN k < 2 AND known THEN 'bird-src' || regexp_extract(name, '[0-9]+$') WHEN k IN (1, 2) THEN 'bird-all' END AS dataset,
      CASE WHEN k = 4 THEN 'connection_name_unknown' WHEN k = 3 OR (k = 0 AND NOT known) THEN 'no_such_database' END AS reason FROM c""",
)
def datasets_of_connections(t: Tables) -> DataFrame:
    """The dataset a connection's name stands for."""
    c, k = F.col("c_custkey"), F.col("c_custkey") % 5
    n = F.concat(F.lit("src"), (c % 30).cast("string"))
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("BIRD-"), n)).when(k == 2, "bird databases").when(
        k == 3, F.concat(F.lit("Sales "), c.cast("string"))
    )
    return Q.dataset_of_connections(t.customer.select(name.alias("name")), Q.database_ids(questions(t)))


KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@check(
    "db_id string, split string, question_id bigint, gold_sql string, original_sql string, gold_source string",
    f"""WITH v AS (SELECT lang AS db_id, {KEY.format('text')} AS key, arg_max(doc_id, doc_id) AS id FROM documents GROUP BY ALL),
    tr AS (SELECT lang AS db_id, {KEY.format("replace(text, ' ', '  -')")} AS key, 'split' || doc_id % 3 AS split, doc_id FROM documents),
    j AS (SELECT tr.db_id, split, id, doc_id, doc_id = id AS same FROM tr JOIN v USING (db_id, key))
    SELECT db_id, split, id AS question_id, CASE WHEN same THEN 'select "a' || doc_id || '"  from T;' ELSE 'SELECT a' || id || ' FROM t' END AS gold_sql,
      CASE WHEN NOT same THEN 'select "a' || doc_id || '"  from T;' END AS original_sql, CASE WHEN same THEN 'bundle' ELSE 'bird_verified' END AS gold_source FROM j""",
)
def questions_matched(t: Tables) -> DataFrame:
    """Translated questions joined to the verified ones by their words; differing gold SQL is replaced."""
    n = F.col("doc_id").cast("string")
    translated = t.documents.select(
        F.col("lang").alias("db_id"), F.replace("text", F.lit(" "), F.lit("  -")).alias("question"), F.concat(F.lit('select "a'), n, F.lit('"  from T;')).alias("sql"),
        F.concat(F.lit("split"), (F.col("doc_id") % 3).cast("string")).alias("split"),
    )
    verified = t.documents.select(
        F.col("lang").alias("db_id"), F.col("text").alias("question"), F.col("doc_id").alias("question_id"),
        F.concat(F.lit("SELECT a"), n, F.lit(" FROM t")).alias("SQL"), F.lit(None).cast("string").alias("grading_method"), "doc_id",
    )
    return Q.match_questions(translated, verified, "doc_id")


@check(
    "gold_source string, n bigint",
    f"""WITH v AS (SELECT lang AS db_id, {KEY.format('text')} AS key, max(doc_id) AS id FROM documents GROUP BY ALL)
    SELECT CASE WHEN doc_id = id THEN 'bundle' ELSE 'bird_verified' END AS gold_source, count(*) AS n
    FROM documents d JOIN v ON d.lang = v.db_id AND {KEY.format("d.text")} = v.key GROUP BY 1""",
)
def gold_source_tally(t: Tables) -> DataFrame:
    """How many questions keep their own gold SQL, and how many take the verified one."""
    return sinks.status_counts(questions_matched(t), F.col("gold_source")).withColumnRenamed("status", "gold_source")


@check(
    "user_id bigint, event_type string, value double",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)
def last_per_key(t: Tables) -> DataFrame:
    """The last record of each key."""
    return Q.last_per_key(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id"], F.col("event_id"))


@check(
    "p_partkey bigint, token string",
    """WITH l AS (SELECT 'id' || s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT r_name, 'region ' || r_regionkey FROM region UNION ALL SELECT n_name, 'nation ' || n_nationkey FROM nation)
    SELECT p_partkey, coalesce((SELECT v FROM l WHERE k = 'id' || p_partkey), (SELECT v FROM l WHERE k = 'NATION_' || p_size), (SELECT v FROM l WHERE k = (SELECT r_name FROM region WHERE r_regionkey = p_size % 9))) AS token FROM part""",
)
def first_key_that_matches(t: Tables) -> DataFrame:
    """A value looked up under several keys, the first that has one wins."""
    lookup = (
        t.supplier.select(F.concat(F.lit("id"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))
        .unionByName(t.region.select(F.col("r_name").alias("key"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("value")))
        .unionByName(t.nation.select(F.col("n_name").alias("key"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("value")))
    )
    named = t.part.join(t.region.withColumn("_r", F.col("r_regionkey")), F.col("p_size") % 9 == F.col("_r"), "left")
    keys = [
        F.concat(F.lit("id"), F.col("p_partkey").cast("string")),
        F.concat(F.lit("NATION_"), F.col("p_size").cast("string")),
        F.col("r_name"),
    ]
    return Q.first_key_match(named, keys, lookup, "token").select("p_partkey", "token")


@check("source string, lang string", "SELECT DISTINCT source, lang FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE doc_id % 3 = 0)")
def missing_names(t: Tables) -> DataFrame:
    """Asked names that are not there."""
    return Q.missing_from(t.documents, t.documents.filter("doc_id % 3 = 0").select("source", "lang").distinct(), ["source", "lang"])


@check(
    "name string",
    "SELECT p_name AS name FROM part WHERE p_partkey % 3 <> 2 UNION SELECT 'x' || p_size FROM part",
)
def allowed_tables(t: Tables) -> DataFrame:
    """Production tables, named or as objects, and extra tables."""
    k = F.col("p_partkey") % 3
    entry = F.when(k == 0, F.col("p_name")).when(k == 1, F.to_json(F.struct(F.col("p_name").alias("name")))).otherwise('{"id": 1}')
    extra = t.part.select(F.concat(F.lit("x"), F.col("p_size").cast("string")).alias("name"))
    return Q.allowed_tables(t.part.select(entry.alias("entry")), extra)


@check(
    "dataset string, id string",
    "SELECT 'bird-src3' AS dataset, 'bird-' || doc_id AS id FROM documents WHERE source = 'src3'",
)
def question_sources(t: Tables) -> DataFrame:
    """A dataset loaded by the source that owns its name."""
    bird = QuestionSource(
        "bird", "bird-", lambda spark, part: Q.to_items(questions(t).filter(F.col("db_id") == part)), lambda part: f"questions of {part}"
    )
    return QuestionSources([bird]).load(t.spark, "BIRD-SRC3 ").select(F.lit("bird-src3").alias("dataset"), "id")


@check(
    "status string, n bigint",
    "SELECT CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'different result' WHEN 2 THEN 'unparsed' ELSE 'error' END AS status, count(*) AS n FROM documents GROUP BY 1",
)
def check_statuses(t: Tables) -> DataFrame:
    """Questions by what their check said."""
    k = F.col("doc_id") % 5
    text = F.when(k == 0, "ok").when(k == 1, "different result").when(k != 2, F.col("text"))
    return sinks.status_counts(t.documents, sinks.check_status(text))


@check("doc_id bigint", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def kept_questions(t: Tables) -> DataFrame:
    """Only the questions whose check passed."""
    return sinks.kept_questions(t.documents.withColumn("check", F.when(F.col("doc_id") % 5 == 0, "ok").otherwise("error")), True)


@check(
    "engine string, db_id string, n bigint, low bigint",
    f"""WITH {VOTES}, o AS (SELECT engine, db_id, count(*) AS n, min(id) AS low FROM e GROUP BY ALL),
    w AS (SELECT engine, db_id, count(*) AS n, min(id) AS low FROM e WHERE engine = 'trino' AND id % 2 = 0 GROUP BY ALL)
    SELECT * FROM w UNION ALL SELECT * FROM o WHERE (engine, db_id) NOT IN (SELECT (engine, db_id) FROM w)""",
)
def merged_verified_lists(t: Tables) -> DataFrame:
    """New verified lists in place of the saved ones of the same engine and database."""
    v = votes(t)
    merged = sinks.merge_verified(v, v.filter("engine = 'trino' AND id % 2 = 0"))
    return merged.groupBy("engine", "db_id").agg(F.count("*").alias("n"), F.min("id").alias("low"))


@check(
    "id bigint, value string",
    """WITH s AS (SELECT doc_id AS id, lang AS value FROM documents), n AS (SELECT doc_id // 2 AS id, arg_max(source, doc_id) AS value FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)""",
)
def upserted_items(t: Tables) -> DataFrame:
    """Items by id, the last write wins."""
    saved = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    new = t.documents.filter("doc_id % 3 = 0").select(F.floor(F.col("doc_id") / 2).alias("id"), F.col("source").alias("value"), F.col("doc_id").alias("at"))
    return sinks.upsert(saved, new, "id", "at")

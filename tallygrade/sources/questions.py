"""Question sets: reading, selecting and filtering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip
from tallygrade.functions.names import connection_key, question_key

QUESTION = (
    "question_id int, db_id string, question string, evidence string, SQL string, "
    "grading_method string, _corrupt_record string"
)


def read_questions(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """One record per line of a JSONL file; blank lines are dropped, bad ones kept aside."""
    return spark.read.schema(schema).json(path)


def parse_items(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejected). raw: id, input STRUCT<query>, expected_output STRUCT<sql, response>, metadata."""
    filled = lambda c: F.when(c != "", c)
    sql = F.coalesce(
        filled(F.col("expected_output.sql")), filled(F.col("expected_output.response")), F.lit("")
    )
    parsed = raw.select(
        F.coalesce("id", F.lit("")).alias("id"), F.col("input.query").alias("query"), sql.alias("expected_sql"),
        "metadata",
    )
    has_query = F.coalesce(F.col("query"), F.lit("")) != ""
    reason = F.concat(
        F.lit("Dataset item '"), F.col("id"), F.lit("' missing required field: input.query")
    )
    return parsed.filter(has_query), parsed.filter(~has_query).select("id", reason.alias("reason"))


def to_items(questions: DataFrame, include_evidence: bool = True, source: str = "questions",
             dialect: str = "sqlite") -> DataFrame:
    """Question rows as dataset items: id, query with hint, trimmed SQL, metadata."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    question, evidence = text("question"), text("evidence")
    hinted = F.concat(question, F.lit("\n\nHint: "), evidence)
    query = F.when(evidence != "", hinted).otherwise(question) if include_evidence else question
    return questions.select(
        F.concat(F.lit("bird-"), F.col("question_id").cast("string")).alias("id"),
        query.alias("query"),
        text("SQL").alias("expected_sql"),
        F.create_map(
            F.lit("source"), F.lit(source),
            F.lit("db_id"), F.col("db_id"),
            F.lit("question_id"), F.col("question_id").cast("string"),
            F.lit("grading_method"), text("grading_method"),
            F.lit("evidence"), evidence,
            F.lit("sql_dialect"), F.lit(dialect),
        ).alias("metadata"),
    )


def database_ids(questions: DataFrame) -> DataFrame:
    """Distinct database ids in order."""
    return questions.select("db_id").distinct().orderBy("db_id")


def only_ids(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return items.join(ids.select(key), key, "left_semi")


def page(items: DataFrame, order: str, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Items in their order, after offset, at most limit."""
    out = items.orderBy(order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def verified_ids(per_engine: DataFrame, pushed: bool = False, pushed_engine: str = "pushed") -> DataFrame:
    """(db_id, id) verified on every engine that lists the database.

    per_engine: engine, db_id, id. With the pushed layout only that engine counts,
    else all but that one. An engine that does not list a database has no say on it.
    """
    counted = per_engine.filter(
        F.col("engine") == pushed_engine if pushed else F.col("engine") != pushed_engine
    )
    once = counted.distinct()
    engines = once.select("db_id", "engine").distinct().groupBy("db_id").agg(F.count("*").alias("_all"))
    votes = once.groupBy("db_id", "id").agg(F.count("*").alias("_votes"))
    return votes.join(engines, "db_id").filter(F.col("_votes") == F.col("_all")).select("db_id", "id")


def with_verified(questions: DataFrame, verified: DataFrame, listed: DataFrame) -> DataFrame:
    """Questions of listed databases only if verified; those of other databases all.

    verified: db_id, id. listed: db_id of the databases that have a verified list,
    even an empty one.
    """
    marked = questions.join(listed.select("db_id", F.lit(True).alias("_listed")), "db_id", "left").join(
        verified.select("db_id", F.col("id").alias("question_id"), F.lit(True).alias("_ok")),
        ["db_id", "question_id"],
        "left",
    )
    return marked.filter(F.col("_listed").isNull() | F.col("_ok").isNotNull()).drop("_listed", "_ok")


def dataset_of_connections(connections: DataFrame, known: DataFrame) -> DataFrame:
    """Which dataset each connection name means.

    connections: name. known: db_id. A known id is its own dataset; another name
    that starts with bird means all of them; else there is none, with the reason.
    """
    keyed = connections.withColumn("_key", connection_key(F.col("name")))
    found = keyed.join(
        known.select(F.col("db_id").alias("_key"), F.lit(True).alias("_known")).distinct(), "_key", "left"
    )
    bird = F.coalesce(F.lower(F.trim("name")).startswith("bird"), F.lit(False))
    dataset = F.when(F.col("_known"), F.concat(F.lit("bird-"), F.col("_key"))).when(bird, "bird-all")
    reason = F.when(F.col("name").isNull(), "connection_name_unknown").otherwise("no_such_database")
    return found.select(
        "name", dataset.alias("dataset"), F.when(dataset.isNull(), reason).alias("reason")
    )


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key by order."""
    rest = [c for c in df.columns if c not in keys]
    body = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.max_by(body, order).alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def match_questions(translated: DataFrame, verified: DataFrame, position: str) -> DataFrame:
    """Translated questions that have a verified one with the same words, with its gold SQL.

    Both are keyed by (db_id, question_key); of verified questions with one key the
    last wins. Where the two gold texts differ, the verified one replaces the stored
    one, which is kept as original_sql.
    translated: db_id, question, sql, split. verified: db_id, question,
    question_id, SQL, grading_method and the position column.
    """
    build = last_per_key(
        verified.select(
            "db_id", question_key(F.col("question")).alias("_key"), "question_id",
            F.col("SQL").alias("_verified"),
            F.coalesce("grading_method", F.lit("")).alias("grading_method"),
            F.col(position).alias("_position"),
        ),
        ["db_id", "_key"],
        F.col("_position"),
    )
    joined = translated.withColumn("_key", question_key(F.col("question"))).join(build, ["db_id", "_key"])
    same = comparable_sql(F.col("sql")) == comparable_sql(F.col("_verified"))
    return joined.select(
        "db_id", "question", "split", "question_id", "grading_method",
        F.when(same, F.col("sql")).otherwise(F.col("_verified")).alias("gold_sql"),
        F.when(~same, F.col("sql")).alias("original_sql"),
        F.when(same, "bundle").otherwise("bird_verified").alias("gold_source"),
    )


def comparable_sql(sql: Column) -> Column:
    """SQL without the differences of form that do not matter: case, space, quotes, last `;`."""
    from tallygrade.functions.statements import normalise_sql

    return F.regexp_replace(normalise_sql(sql), '[`"]', "")


def first_key_match(df: DataFrame, keys: list[Column], lookup: DataFrame, out: str) -> DataFrame:
    """Add the lookup value under the first of several keys that has one.

    lookup: key, value (one value per key). Each key is an equi-join of its own.
    """
    names = [f"_{out}{i}" for i in range(len(keys))]
    for name, key in zip(names, keys):
        side = lookup.select(F.col("key").alias(f"{name}k"), F.col("value").alias(name))
        df = df.withColumn(f"{name}j", key)
        df = df.join(side, F.col(f"{name}j") == F.col(f"{name}k"), "left").drop(f"{name}j", f"{name}k")
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def missing_from(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(present, keys, "left_anti")


def allowed_tables(production: DataFrame, extra: DataFrame) -> DataFrame:
    """Distinct names: production entries are texts or objects with a name, extra are texts."""
    name = F.coalesce(F.get_json_object("entry", "$.name"), F.when(~F.col("entry").startswith("{"), F.col("entry")))
    names = production.select(name.alias("name")).unionByName(extra.select("name"))
    return names.filter(F.coalesce("name", F.lit("")) != "").distinct()

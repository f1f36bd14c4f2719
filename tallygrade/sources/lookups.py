"""Lookups and schema maps read from files or a catalog scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip

# Fixed patterns: dates as text.
DATE_VALUE = r"^\d{4}-\d{2}-\d{2}$"
MOMENT_VALUE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
DATE_NAME = r"(?i)(^|_)(date|dt|datetime|timestamp)($|_)|date$"
TEXT_TYPE = "char|text|string|clob"


def lookup_csv(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(strip(F.col(key)).alias("key"), strip(F.col(value)).alias("value"))


def lookup_entries(documents: DataFrame) -> DataFrame:
    """(key, value) from JSON documents: an object, a list of pairs, or a list of objects.

    An object in a list has one field with `token` in its name (else `key`): the
    value of all its other fields. documents: body.
    """
    whole = F.from_json("body", "map<string,string>")
    flat = documents.filter(~F.ltrim("body").startswith("[")).select(F.explode(whole).alias("key", "value"))
    items = documents.filter(F.ltrim("body").startswith("[")).select(
        F.explode(F.from_json("body", "array<string>")).alias("item")
    )
    pair = F.from_json("item", "array<string>")
    pairs = items.filter(F.col("item").startswith("[")).select(pair[0].alias("key"), pair[1].alias("value"))
    fields = items.filter(F.col("item").startswith("{")).select(
        F.map_entries(F.from_json("item", "map<string,string>")).alias("f")
    )

    def named(word: str) -> Column:
        return F.filter("f", lambda e: F.lower(e["key"]).contains(word))

    holder = F.when(F.size(named("token")) == 1, named("token")[0]).when(
        F.size(named("key")) == 1, named("key")[0]
    )
    objects = fields.withColumn("h", holder).filter(F.col("h").isNotNull())
    others = objects.select(
        F.explode(F.filter("f", lambda e: (e["key"] != F.col("h.key")) & (e["value"] != ""))).alias("e"),
        F.col("h.value").alias("value"),
    ).select(F.col("e.value").alias("key"), "value")
    entries = flat.unionByName(pairs).unionByName(others)
    return entries.select(strip(F.col("key")).alias("key"), strip(F.col("value")).alias("value"))


def conflicting_keys(entries: DataFrame) -> DataFrame:
    """Keys with more than one value; a lookup with any is refused."""
    n = entries.distinct().groupBy("key").agg(F.count("*").alias("n_values"))
    return n.filter("n_values > 1")


def settled_lookup(entries: DataFrame) -> DataFrame:
    """One value per key, failing the job on a key with two."""
    checked = entries.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    refuse = F.raise_error(F.concat(F.lit("key with two different values: "), F.col("key")))
    return checked.select(
        "key", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(refuse.cast("string")).alias("value")
    )


def text_date_type(db_type: Column, examples: Column, semantic_type: Column, name: Column) -> Column:
    """Type of a catalog column for the time shift: text that holds dates gets a type of its own.

    Judged by the example values, or by the semantic type or the name without any.
    """
    t = F.lower(strip(F.coalesce(F.nullif(db_type, F.lit("")), F.lit("varchar"))))
    kept = F.filter(
        F.transform(examples, strip), lambda v: v.isNotNull() & (v != "")
    )
    some = F.coalesce(F.size(kept) > 0, F.lit(False))
    by_name = (F.coalesce(semantic_type, F.lit("")) == "time") | name.rlike(DATE_NAME)
    return (
        F.when(~t.rlike(TEXT_TYPE), t)
        .when(some & F.forall(kept, lambda v: v.rlike(DATE_VALUE)), "date_string")
        .when(
            some & F.forall(kept, lambda v: v.rlike(DATE_VALUE) | v.rlike(MOMENT_VALUE)),
            "timestamp_string",
        )
        .when(some, t)
        .when(by_name, "date_string")
        .otherwise(t)
    )


def profile_text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type) of text columns judged over all their values, in one pass."""
    checks = []
    for i, c in enumerate(columns):
        v = F.nullif(strip(F.col(c)), F.lit(""))
        checks += [
            F.bool_and(v.rlike(DATE_VALUE)).alias(f"d{i}"),
            F.bool_and(v.rlike(DATE_VALUE) | v.rlike(MOMENT_VALUE)).alias(f"m{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"d{i}"), "date_string").when(F.col(f"m{i}"), "timestamp_string")
            .otherwise("varchar").alias("type"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*checks).select(F.inline(F.array(*entries)))


def schema_columns(catalog: DataFrame) -> DataFrame:
    """Long schema map (table_key, column, type): each table under 1 to 3 keys.

    catalog: catalog, schema, table, column_name, type, seq. Keys are lower case,
    column names keep their case, blank names are dropped, the last type wins.
    """
    low = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    named = catalog.select(
        low("table").alias("t"), low("schema").alias("s"), low("catalog").alias("c"),
        strip(F.coalesce("column_name", F.lit(""))).alias("column"), "type", "seq",
    ).filter((F.col("t") != "") & (F.col("column") != ""))
    keys = F.array_compact(
        F.array(
            F.col("t"),
            F.when(F.col("s") != "", F.concat_ws(".", "s", "t")),
            F.when((F.col("s") != "") & (F.col("c") != ""), F.concat_ws(".", "c", "s", "t")),
        )
    )
    return (
        named.select(F.explode(keys).alias("table_key"), "column", "type", "seq")
        .groupBy("table_key", "column")
        .agg(F.max_by("type", "seq").alias("type"))
    )


def schema_map(columns: DataFrame) -> DataFrame:
    """Output form: one row per table key with its MAP column -> type."""
    entries = F.array_sort(F.collect_list(F.struct("column", "type")))
    return columns.groupBy("table_key").agg(F.map_from_entries(entries).alias("columns"))


def lookup_tables(references: DataFrame, columns: DataFrame) -> DataFrame:
    """The most specific schema key each reference finds.

    references: ref, catalog, schema, table. Adds table_key (NULL: unknown).
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    keys = F.array(
        F.when((low("catalog") != "") & (low("schema") != ""),
               F.concat_ws(".", low("catalog"), low("schema"), low("table"))),
        F.when(low("schema") != "", F.concat_ws(".", low("schema"), low("table"))),
        low("table"),
    )
    known = columns.select("table_key").distinct()
    tried = references.select("ref", F.posexplode(keys).alias("priority", "table_key"))
    hit = tried.filter(F.col("table_key").isNotNull()).join(known, "table_key").groupBy("ref").agg(
        F.min_by("table_key", "priority").alias("table_key")
    )
    return references.join(hit, "ref", "left")

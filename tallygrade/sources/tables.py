"""Tables of a benchmark database: types, values, names, keys and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrade.functions.names import clean_name
from tallygrade.sources.batches import joined_on

# Kinds a column can have and the types they are stored as.
KINDS = {"bigint": "long", "double": "double", "binary": "binary", "text": "string"}
FIELD_TYPES = {"bigint": "long", "double": "double", "text": "string", "binary": "string"}
SCHEMA_FILE = "tables array<struct<name:string,columns:array<struct<name:string,trino_type:string>>>>"


def declared_kind(declared: Column) -> Column:
    """Kind a declared column type asks for; dates and everything unknown are text."""
    d = F.upper(F.coalesce(declared, F.lit("")))
    return (
        F.when(d.contains("INT"), "bigint")
        .when(d.rlike("REAL|FLOA|DOUB|NUMERIC|DECIMAL"), "double")
        .when(d.contains("BLOB"), "binary")
        .otherwise("text")
    )


def kind_of(dtype: T.DataType) -> str:
    """Kind of a column whose type Spark already knows."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "double"
    return "binary" if isinstance(dtype, T.BinaryType) else "text"


INTEGER_TEXT = r"^[-+]?\d+$"
NUMBER_TEXT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def fits(c: Column, kind: str) -> Column:
    """Does a text value fit the kind? NULL fits every kind."""
    if kind == "bigint":
        ok = c.rlike(INTEGER_TEXT) & c.try_cast("bigint").isNotNull()
    elif kind == "double":
        ok = c.rlike(NUMBER_TEXT)
    else:
        ok = F.lit(True)
    return c.isNull() | ok


def infer_kinds(df: DataFrame, declared: dict[str, str] | None = None,
                given: dict[str, str] | None = None) -> DataFrame:
    """(column, kind): the narrowest kind every value fits, for text columns.

    Only the declared kind is tried, and it is kept if every value that is not NULL
    fits, else the column is text. Without a declaration bigint and then double are
    tried. Kinds in `given` are taken as they are. One pass over all columns.
    """
    given, declared = given or {}, declared or {}
    aggregates, tried = [], {}
    for i, c in enumerate(df.columns):
        if c in given:
            continue
        tried[c] = [declared[c]] if c in declared else ["bigint", "double"]
        for kind in tried[c]:
            if kind in ("bigint", "double"):
                aggregates.append(F.bool_and(fits(F.col(f"`{c}`"), kind)).alias(f"{kind}_{i}"))
    checked = df.agg(*aggregates) if aggregates else df.sparkSession.range(1).select()
    entries = []
    for i, c in enumerate(df.columns):
        kind = F.lit(given.get(c, "text"))
        for k in reversed(tried.get(c, [])):
            if k in ("bigint", "double"):
                kind = F.when(F.coalesce(F.col(f"{k}_{i}"), F.lit(True)), k).otherwise(kind)
            else:
                kind = F.lit(k)
        entries.append(F.struct(F.lit(c).alias("column"), kind.alias("kind")))
    return checked.select(F.inline(F.array(*entries)))


def given_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, kind) from a schema file that overrides inference."""
    raw = spark.read.schema(SCHEMA_FILE).option("multiLine", True).json(path)
    return kinds_of_schema(raw)


def kinds_of_schema(raw: DataFrame) -> DataFrame:
    """raw: tables ARRAY<STRUCT<name, columns ARRAY<STRUCT<name, trino_type>>>>."""
    tables = raw.select(F.explode("tables").alias("t"))
    columns = tables.select(F.col("t.name").alias("table"), F.explode("t.columns").alias("c"))
    kind = F.when(F.col("c.trino_type") == "varbinary", "binary").when(
        F.col("c.trino_type").isin("bigint", "double"), F.col("c.trino_type")
    ).otherwise("text")
    return columns.select("table", F.col("c.name").alias("column"), kind.alias("kind"))


def to_kind(c: Column, dtype: T.DataType, kind: str) -> Column:
    """A value as its kind: text for text, UTF-8 for bytes, doubles for whole numbers; no NUL characters."""
    if kind == "text":
        text = F.decode(c, "UTF-8") if isinstance(dtype, T.BinaryType) else c.cast("string")
        return F.replace(text, F.lit("\x00"), F.lit(""))
    if isinstance(dtype, T.StringType):
        return c.try_cast(KINDS[kind])
    return c.cast(KINDS[kind])


def sendable(c: Column, kind: str) -> Column:
    """A value as JSON can carry it: blobs as base64, NaN and infinities as NULL."""
    if kind == "binary":
        return F.base64(c)
    if kind == "double":
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return c


def as_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[to_kind(F.col(f"`{c}`"), types[c], k).alias(c) for c, k in kinds.items()])


def write_table(df: DataFrame, path: str, table: str) -> tuple[DataFrame, object]:
    """Write df with lower-case column names, replacing an earlier load.

    Returns the loaded table and an Observation that holds its row count, so
    counting costs no second pass.
    """
    from pyspark.sql import Observation

    seen = Observation(table)
    named = df.toDF(*[c.lower() for c in df.columns])
    named.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/{table.lower()}")
    return df.sparkSession.read.parquet(f"{path}/{table.lower()}"), seen


def find_databases(files: DataFrame, extension: str = "parquet") -> DataFrame:
    """(db_id, path) among file paths: `<id>.ext`, or `<id>/<id>.ext` where there is no flat file.

    files: path, relative to the folder that is searched.
    """
    stem = F.regexp_extract("path", rf"^(?:([^/]+)/)?([^/]+)\.{extension}$", 2)
    folder = F.regexp_extract("path", rf"^(?:([^/]+)/)?([^/]+)\.{extension}$", 1)
    known = files.withColumns({"db_id": stem, "_folder": folder}).filter(
        (F.col("db_id") != "") & ((F.col("_folder") == "") | (F.col("_folder") == F.col("db_id")))
    )
    return known.groupBy("db_id").agg(F.min_by("path", F.length("_folder")).alias("path"))


def list_files(spark: SparkSession, folder: str, extension: str = "parquet") -> DataFrame:
    """Paths under a folder, relative to it; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{extension}")
        .load(folder)
    )
    root = folder.rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"))


def unique_names(names: DataFrame, keys: list[str], position: str, name: str, out: str) -> DataFrame:
    """Clean names made unique per key in the order they come: a_b, a_b_2, a_b_3.

    names has one row per column of a table. Equal clean names are numbered by a window. Only where a clean
    name already ends in a number can it meet the number of another one: names that differ by such ends are
    settled together, in their order, each with the least number that is still free. Null names count as empty.
    """
    listed = names.withColumn("_clean", clean_name(F.coalesce(F.col(name), F.lit("")))).withColumn("_family", F.regexp_replace("_clean", "(_[0-9]+)+$", ""))
    alike, family = Window.partitionBy(*keys, "_clean").orderBy(position), Window.partitionBy(*keys, "_family")
    listed = listed.withColumn("_n", F.row_number().over(alike)).withColumn("_mixed", F.min("_clean").over(family) != F.max("_clean").over(family))
    numbered = F.when(F.col("_n") == 1, F.col("_clean")).otherwise(F.concat("_clean", F.lit("_"), F.col("_n").cast("string")))
    single = listed.filter("NOT _mixed").withColumn(out, numbered).select(*names.columns, out)

    def settled(pdf):
        used, after, taken = set(), {}, []
        pdf = pdf.sort_values(position)
        for clean in pdf["_clean"]:
            unique = clean
            if clean in used:
                n = after.get(clean, 2)
                while f"{clean}_{n}" in used:
                    n += 1
                after[clean], unique = n + 1, f"{clean}_{n}"
            used.add(unique)
            taken.append(unique)
        return pdf.assign(**{out: taken})[[*keys, position, out]]

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in (listed.schema[c] for c in [*keys, position])]
    mixed = listed.filter("_mixed")
    found = mixed.select(*keys, position, "_clean", "_family").groupBy(*keys, "_family").applyInPandas(settled, f"{', '.join(fields)}, `{out}` string")
    return single.unionByName(joined_on(mixed.select(*names.columns), found, keys, position))


def renamed(df: DataFrame, new_names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(new_names.get(c, c)) for c in df.columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Primary-key audit: key values that occur more than once (a NULL never counts as a key)."""
    whole = [F.col(k).isNotNull() for k in keys]
    condition = whole[0]
    for w in whole[1:]:
        condition = condition & w
    return df.filter(condition).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, referenced: list[str]) -> DataFrame:
    """Foreign-key audit: child rows whose reference has no parent; NULL references are skipped."""
    side = parent.select(*[F.col(r).alias(f"_ref{i}") for i, r in enumerate(referenced)])
    condition = [F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=columns).join(side, condition, "left_anti")


def load_plan(columns: DataFrame, database: str, namespace: str = "benchmark") -> DataFrame:
    """One row per table: target name, old -> new column names, kinds, field list as JSON.

    columns: table, pos, column, kind. Field ids are hashes of their full name, so a
    dry run shows what a load sends.
    """
    from tallygrade.functions.names import target_table_name

    named = unique_names(columns, ["table"], "pos", "column", "field")
    full = F.concat_ws(".", F.lit(f"{namespace}/{database}"), "table", "field")
    kinds = F.create_map(*[x for k, v in FIELD_TYPES.items() for x in (F.lit(k), F.lit(v))])
    entry = F.struct(
        "pos",
        F.struct(
            F.col("field").alias("name"),
            F.array(F.lit("null"), F.try_element_at(kinds, F.col("kind"))).alias("type"),
            F.sha1(full).alias("id"),
        ).alias("f"),
        F.struct(F.col("column").alias("key"), F.col("field").alias("value")).alias("c"),
        "kind",
    )
    per = named.groupBy("table").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return per.select(
        "table",
        target_table_name(F.lit(database), F.col("table")).alias("target"),
        F.map_from_entries(F.transform("all", lambda x: x["c"])).alias("columns"),
        F.transform("all", lambda x: x["kind"]).alias("kinds"),
        F.to_json(F.transform("all", lambda x: x["f"])).alias("fields"),
    )

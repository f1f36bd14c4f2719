"""Scores of SQL texts: exact match, clause by clause, and whether names exist.

Statements that are not flat (see functions.statements) are not applicable with
the reason `not_flat`, unless their texts are equal anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.functions import statements as S
from tallygrade.functions.figures import rounded
from tallygrade.operators.bags import bag_difference
from tallygrade.operators.outcomes import blank, result
from tallygrade.session import cut

# Fixed value: differing items listed per clause.
SHOWN_ITEMS = 10


def parsed(cases: DataFrame, partitions: int | None = None) -> DataFrame:
    """cases (case_id, expected_sql, generated_sql) with both statements taken apart: e, g.

    Written once and read by every score: a filter on what was found would else be
    pushed through all steps of the parsing and repeat them. Parsing is heavy on the
    processor and light on data: `partitions` spreads a small file over the cores.
    """
    if partitions:
        cases = cases.repartition(partitions, "case_id")
    both = S.take_apart(S.take_apart(cases, "expected_sql", "e"), "generated_sql", "g")
    return cut(both, "statements")


def exact_match(statements: DataFrame) -> DataFrame:
    """1 when the canonical texts are equal."""
    both = F.col("e.flat") & F.col("g.flat")
    same_text = S.normalise_sql(F.col("expected_sql")) == S.normalise_sql(F.col("generated_sql"))
    same = same_text | (both & (S.canonical(F.col("e")) == S.canonical(F.col("g"))))
    df = statements.withColumn("_same", same).withColumn("_both", both)
    no_gold, no_answer = blank("expected_sql"), blank("generated_sql")
    open_ended = ~no_gold & ~no_answer & ~F.col("_same") & ~F.col("_both")
    reason = (
        F.when(no_gold, "no_expected_sql").when(no_answer, "no_generated_sql").when(open_ended, "not_flat")
    )
    score = F.when(~no_answer & F.col("_same"), 1.0).otherwise(0.0)
    return result(df, "sql_exact_match", score, ~(no_gold | open_ended), reason)


def clause_items(statements: DataFrame) -> DataFrame:
    """Long form: case_id, side, clause, token, for cases with two flat statements."""
    both = statements.filter(F.col("e.flat") & F.col("g.flat"))
    sides = F.array(
        F.struct(F.lit("e").alias("side"), S.clause_tokens(F.col("e")).alias("tokens")),
        F.struct(F.lit("g").alias("side"), S.clause_tokens(F.col("g")).alias("tokens")),
    )
    return both.select("case_id", F.inline(sides)).select(
        "case_id", "side", F.inline("tokens")
    )


def clause_scores(items: DataFrame) -> DataFrame:
    """F1 per (case, clause) that either side uses, with up to ten missing and extra items."""
    per_item = bag_difference(items, ["case_id", "clause"], "token")

    def listed(n: str) -> Column:
        copies = F.flatten(
            F.collect_list(F.array_repeat("token", F.least(F.col(n), F.lit(SHOWN_ITEMS)).cast("int")))
        )
        return F.slice(F.array_sort(copies), 1, SHOWN_ITEMS).alias(n)

    shared = F.sum("shared")
    both = 2 * shared + F.sum("missing") + F.sum("extra")
    return per_item.groupBy("case_id", "clause").agg(
        rounded(2 * shared / both, 4).alias("f1"), listed("missing"), listed("extra")
    )


def mean_clause_score(scores: DataFrame) -> DataFrame:
    """Mean of the rounded clause scores."""
    return scores.groupBy("case_id").agg(rounded(F.avg("f1"), 4).alias("mean_f1"))


def component_match(statements: DataFrame) -> DataFrame:
    means = mean_clause_score(clause_scores(clause_items(statements)))
    slim = statements.select(
        "case_id", "expected_sql", "generated_sql", F.col("e.flat").alias("_e"), F.col("g.flat").alias("_g")
    )
    df = slim.join(means, "case_id", "left")
    no_gold, no_answer = blank("expected_sql"), blank("generated_sql")
    open_ended = ~no_gold & ~no_answer & ~(F.col("_e") & F.col("_g"))
    reason = (
        F.when(no_gold, "no_expected_sql").when(no_answer, "no_generated_sql").when(open_ended, "not_flat")
    )
    score = F.when(no_answer, 0.0).otherwise(F.coalesce("mean_f1", F.lit(1.0)))
    return result(df, "component_match", score, ~(no_gold | open_ended), reason)


def source_tables(statements: DataFrame, side: str = "g") -> DataFrame:
    """Long form: case_id, alias, full, db, name of every table a flat statement reads."""
    sources = statements.filter(F.col(f"{side}.flat")).select("case_id", F.inline(f"{side}.sources"))
    parts = F.split("full", r"\.")
    return sources.select(
        "case_id",
        F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")).alias("alias"),
        "full",
        F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise("").alias("db"),
        "name",
    )


def resolve_tables(sources: DataFrame, schema: DataFrame) -> DataFrame:
    """Add `columns` (lower case) of each table, NULL when it does not exist.

    A name with a schema must match that schema; the bare name is tried only when
    no key of any schema ends with it. schema: table_key, column.
    """
    tables = schema.groupBy(F.lower("table_key").alias("key")).agg(
        F.collect_set(F.lower("column")).alias("columns")
    )
    qualified = tables.select(F.col("key").alias("_full"), F.col("columns").alias("_by_schema"))
    bare = tables.select(F.col("key").alias("name"), F.col("columns").alias("_by_name"))
    known = (
        tables.filter(F.col("key").contains("."))
        .select(F.substring_index("key", ".", -1).alias("name"), F.lit(True).alias("_elsewhere"))
        .distinct()
    )
    joined = (
        sources.withColumn("_full", F.concat_ws(".", "db", "name"))
        .join(qualified, "_full", "left")
        .join(bare, "name", "left")
        .join(known, "name", "left")
    )
    columns = F.when(
        F.col("db") != "",
        F.coalesce("_by_schema", F.when(F.col("_elsewhere").isNull(), F.col("_by_name"))),
    ).otherwise(F.col("_by_name"))
    return joined.select("case_id", "alias", "full", "db", "name", columns.alias("columns"))


def resolve_references(statements: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per flat statement the tables and columns that do not exist.

    A qualified column is looked up in its source; an unknown qualifier belongs to
    an outer query and is skipped, as are columns of unknown tables. A bare column
    that is an output name is skipped; another one is missing only when every
    source is known and none has it.
    """
    per_case = resolved.groupBy("case_id").agg(
        F.collect_list(F.struct("alias", "name", "full", F.col("columns").isNotNull().alias("known"),
                                F.coalesce("columns", F.expr("cast(array() as array<string>)")).alias("columns"))).alias("sources")
    )
    slim = statements.filter(F.col("g.flat")).select(
        "case_id",
        S.references(F.col("g")).alias("refs"),
        F.filter(F.col("g.items.alias"), lambda a: a != "").alias("outputs"),
    )
    df = slim.join(per_case, "case_id", "left").withColumn(
        "sources", F.coalesce("sources", F.expr(
            "cast(array() as array<struct<alias:string,name:string,full:string,known:boolean,columns:array<string>>>)"))
    )
    has = lambda src, col: F.array_contains(src["columns"], col)
    source = lambda q: F.get(F.filter("sources", lambda s: s["alias"] == q), 0)

    def missing(r: Column) -> Column:
        src = source(r["qualifier"])
        qualified = F.when(
            src.isNotNull() & src["known"] & ~has(src, r["name"]),
            F.concat(src["name"], F.lit("."), r["name"]),
        )
        owned = F.exists("sources", lambda s: s["known"] & has(s, r["name"]))
        all_known = (F.size("sources") > 0) & F.forall("sources", lambda s: s["known"])
        bare = F.when(~owned & all_known & ~F.array_contains("outputs", r["name"]), r["name"])
        return F.when(r["qualifier"] != "", qualified).otherwise(bare)

    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
    return df.select(
        "case_id",
        tidy(F.transform("sources", lambda s: F.when(~s["known"], s["full"]))).alias("missing_tables"),
        tidy(F.transform("refs", missing)).alias("missing_columns"),
    )


def schema_validity(statements: DataFrame, schema: DataFrame, has_schema: bool = True) -> DataFrame:
    """1 when every table and column of the generated SQL exists."""
    found = resolve_references(statements, resolve_tables(source_tables(statements), schema))
    df = statements.select("case_id", "generated_sql", F.col("g.flat").alias("_flat")).join(
        found, "case_id", "left"
    )
    no_answer = blank("generated_sql")
    reason = F.when(no_answer, "no_generated_sql").when(
        F.lit(not has_schema), "schema_metadata_unavailable"
    ).when(~F.col("_flat"), "not_flat")
    clean = (F.size("missing_tables") == 0) & (F.size("missing_columns") == 0)
    details = F.create_map(
        F.lit("missing_tables"), F.concat_ws(",", "missing_tables"),
        F.lit("missing_columns"), F.concat_ws(",", "missing_columns"),
    )
    return result(
        df, "schema_validity", F.when(clean, 1.0).otherwise(0.0), reason.isNull(), reason, details=details
    )

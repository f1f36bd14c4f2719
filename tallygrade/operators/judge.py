"""Judging: batches for a model, its replies joined back, decisions kept across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrade.functions.cells import strip
from tallygrade.operators.outcomes import result

# How much of a result, cell or failure text a judge is shown.
SHOWN_ROWS = 50
CELL_CHARS = 80
FAILURE_CHARS = 1500
MIN_CONFIDENCE = 80


def shown_cell(value: Column) -> Column:
    """NULL spelled out, newlines to spaces, cut to 80 characters with an ellipsis."""
    text = F.replace(F.coalesce(value, F.lit("NULL")), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(text, 1, CELL_CHARS - 1), F.lit("…"))
    return F.when(F.length(text) > CELL_CHARS, cut).otherwise(text)


def shown_row(values: Column) -> Column:
    return F.concat_ws(" | ", F.transform(values, shown_cell))


def first_rows(rows: DataFrame, keys: list[str], n: int = SHOWN_ROWS) -> DataFrame:
    """Rows whose position is under n. The position is known, so nothing is ranked."""
    return rows.filter(F.col("row_id") < n)


def result_tables(rows: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """`table`: header, first 50 rows and how many more there are, per key.

    rows: keys, row_id, vals ARRAY<STRING> (raw cells). shapes: keys, columns,
    n_rows, total.
    """
    shown = (
        first_rows(rows, keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("row_id", shown_row("vals").alias("line")))).alias("lines"))
    )
    count = row_count()
    hidden = count - F.least(F.col("n_rows"), F.lit(SHOWN_ROWS))
    note = F.when(
        hidden > 0, F.concat(F.lit("... "), hidden.cast("string"), F.lit(" more rows not shown"))
    )
    lines = F.concat(
        F.array(shown_row(F.col("columns"))),
        F.coalesce(F.transform("lines", lambda x: x["line"]), F.expr("cast(array() as array<string>)")),
    )
    return shapes.join(shown, keys, "left").select(
        *keys, F.concat_ws("\n", lines, note).alias("table")
    )


def row_count() -> Column:
    """Total rows if counted, else the rows that came."""
    return F.coalesce(F.nullif("total", F.lit(0)), F.nullif("n_rows", F.lit(0)), F.lit(0)).cast("long")


def summaries(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """shape, row_count and key_characteristic texts per key."""
    n = row_count().cast("string")
    names = F.concat_ws(", ", "columns")
    note = F.when(
        F.col("cut"),
        F.concat(F.lit("; only the first "), F.col("n_rows").cast("string"), F.lit(" rows were returned")),
    ).otherwise("")
    return shapes.select(
        *keys,
        F.concat(n, F.lit(" rows x "), F.size("columns").cast("string"), F.lit(" columns")).alias("shape"),
        n.alias("row_count"),
        F.concat(
            F.lit("columns: "), F.when(names == "", "none").otherwise(names), note
        ).alias("key_characteristic"),
    )


def failure_text(reason: Column, details: Column) -> Column:
    """The reason in words with the scalar details behind it, cut to 1500 characters."""
    shown = F.map_filter(details, lambda k, v: k != "reason")
    pairs = F.transform(
        F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    words = F.replace(reason, F.lit("_"), F.lit(" "))
    tail = F.when(
        F.size(shown) > 0, F.concat(F.lit(" ("), F.concat_ws(", ", pairs), F.lit(")"))
    ).otherwise("")
    return F.substring(F.concat(words, tail), 1, FAILURE_CHARS)


def fill_prompt(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{name}} replaced; NULL counts as empty.

    The template is cut at its marks first, so a value that contains a mark stays
    as it is.
    """
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))
    texts = F.split(template, r"\{\{\s*\w+\s*\}\}")
    known = F.create_map(
        *[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    )
    filled = F.transform(
        names,
        lambda n: F.coalesce(
            F.try_element_at(known, n), F.concat(F.lit("{{"), n, F.lit("}}"))
        ),
    )
    parts = F.zip_with(texts, filled, lambda t, v: F.concat(t, F.coalesce(v, F.lit(""))))
    return F.array_join(parts, "")


def request_key(model: str, prompt: str, question: Column) -> Column:
    """Stable key of one decision: model, prompt and trimmed question."""
    nul = "\x00"
    return F.sha2(F.concat_ws(nul, F.lit(model), F.lit(prompt), strip(question)), 256)


def undecided(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions whose key has no saved decision, one row per key."""
    return questions.join(decisions.select("key"), "key", "left_anti").dropDuplicates(["key"])


def request_batch(asked: DataFrame, model: str, prompt: Column, max_tokens: int = 2048) -> DataFrame:
    """(key, request): one JSON body per key."""
    text = F.concat(prompt, F.lit("\n/no_think")) if "qwen" in model.lower() else prompt
    body = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"),
            F.lit(0).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    )
    return asked.select("key", body.alias("request"))


def add_decisions(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved decisions with the new ones that could be read; errors are not kept."""
    readable = new.filter(F.col("requires_order").isNotNull())
    fresh = readable.join(saved.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return saved.unionByName(fresh.select(*saved.columns))


def decided(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions with their saved decision, and where it came from."""
    found = decisions.select("key", "requires_order", F.lit("cache").alias("source"))
    return questions.join(found, "key", "left").fillna("unavailable", ["source"])


def judge_overlay(results: DataFrame, cases: DataFrame, verdicts: DataFrame,
                  min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """Evaluator results after the judge's look at failed contains checks.

    Judged are contains results that are applicable, failed and free of errors. A
    confident false-negative verdict makes the score 1 and keeps the original; each
    judged case gets an `llm_judge` row. cases: case_id, expected_ok, generated_ok.
    verdicts: case_id, is_false_negative, confidence, error.
    """
    asked = (
        results.filter(
            (F.col("evaluator") == "contains_accuracy")
            & F.col("applicable") & ~F.col("passed") & F.col("error").isNull()
        )
        .select("case_id", F.col("reason").alias("_reason"))
        .join(cases.select("case_id", "expected_ok", "generated_ok"), "case_id")
        .join(
            verdicts.select(
                "case_id", "is_false_negative", "confidence", F.col("error").alias("_error"),
                F.lit(True).alias("_replied"),
            ),
            "case_id", "left",
        )
    )
    ran = F.coalesce(F.col("generated_ok") & F.col("expected_ok"), F.lit(False))
    readable = F.coalesce(F.col("_replied"), F.lit(False)) & F.col("_error").isNull()
    over = (
        ran & readable & F.coalesce("is_false_negative", F.lit(False))
        & (F.coalesce("confidence", F.lit(0)) >= min_confidence)
    )
    asked = asked.withColumn("_over", over).withColumn(
        "_why",
        F.when(~ran, "generated_sql_did_not_run").when(~readable, "judge_unavailable"),
    )
    rows = result(
        asked, "llm_judge", F.when(F.col("_over"), 1.0).otherwise(0.0), F.col("_why").isNull(),
        F.col("_why"), F.when(F.col("_why") == "judge_unavailable", F.col("_error")),
        F.map_filter(
            F.create_map(
                F.lit("judged_failure_reason"), F.coalesce("_reason", F.lit("results_differ")),
                F.lit("confidence"), F.col("confidence").cast("string"),
                F.lit("overturned"), F.col("_over").cast("string"),
            ),
            lambda k, v: v.isNotNull(),
        ),
    )
    turned = asked.filter("_over").select("case_id", F.lit(True).alias("_turned"))
    joined = results.join(turned, "case_id", "left")
    hit = F.col("_turned").isNotNull() & (F.col("evaluator") == "contains_accuracy")
    kept = F.map_concat(
        F.coalesce("details", F.expr("cast(map() as map<string,string>)")),
        F.create_map(
            F.lit("overturned_by_llm_judge"), F.lit("true"),
            F.lit("original_score"), F.col("score").cast("string"),
        ),
    )
    after = joined.select(
        "case_id", "evaluator",
        F.when(hit, 1.0).otherwise(F.col("score")).alias("score"),
        F.when(hit, True).otherwise(F.col("passed")).alias("passed"),
        "applicable", "reason", "error",
        F.when(hit, kept).otherwise(F.col("details")).alias("details"),
    )
    return after.unionByName(rows)

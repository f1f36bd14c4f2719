"""Agent and judge replies: conversation turns wrapped as the replies of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.functions import replies as R
from tallygrade.operators import judge as J
from tallygrade.operators.outcomes import result


def turns(t: Tables) -> DataFrame:
    k = (F.col("conv_id") * 7 + F.col("turn")).cast("long")
    return t.conversations.select("conv_id", "turn", "role", "text", k.alias("k"))


TURNS = "v AS (SELECT *, conv_id * 7 + turn AS k FROM conversations)"


def quoted(c):
    return F.to_json(F.struct(c.alias("v")))


@check(
    "conv_id bigint, turn bigint, status string, sql string, error string, summary string",
    f"""WITH {TURNS} SELECT conv_id, turn,
      CASE k % 8 WHEN 2 THEN 'partial' WHEN 5 THEN 'error' WHEN 6 THEN 'error' ELSE 'completed' END AS status,
      CASE k % 8 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'select ' || k END AS sql,
      CASE k % 8 WHEN 5 THEN 'agent returned no SQL' WHEN 6 THEN 'broken' END AS error,
      CASE k % 8 WHEN 0 THEN text WHEN 1 THEN 'x' WHEN 4 THEN '```sql' || chr(10) || 'select ' || k || chr(10) || '```' WHEN 5 THEN text
        WHEN 3 THEN NULL WHEN 7 THEN 'Select ' || k || chr(10) END AS summary
    FROM v""".replace("'select ' || k END AS sql", "CASE WHEN k % 8 = 7 THEN 'Select ' ELSE 'select ' END || k END AS sql"),
)
def answers_with_sql(t: Tables) -> DataFrame:
    """SQL found in an answer: under a key, nested, fenced, or the whole text."""
    k, n = F.col("k") % 8, F.col("k").cast("string")
    sql = F.concat(F.lit("select "), n)
    body = (
        F.when(k == 0, F.to_json(F.struct(sql.alias("sql_query"), F.col("text").alias("summary"))))
        .when(k == 1, F.to_json(F.struct(F.lit("x").alias("summary"), F.struct(F.struct(sql.alias("generated_sql")).alias("data")).alias("result"))))
        .when(k == 2, F.to_json(F.struct(F.lit("none").alias("sql"), F.lit("partial").alias("status"), sql.alias("query"))))
        .when(k == 3, F.to_json(F.struct(F.concat(F.lit("Use ```sql\n"), sql, F.lit("\n```")).alias("output"))))
        .when(k == 4, F.concat(F.lit("```sql\n"), sql, F.lit("\n```")))
        .when(k == 5, F.col("text"))
        .when(k == 6, F.to_json(F.struct(F.lit("broken").alias("error"))))
        .otherwise(F.concat(F.lit("Select "), n, F.lit("\n")))
    )
    wrapped = turns(t).withColumn("body", body)
    a = wrapped.select("conv_id", "turn", R.parse_answer(F.col("body")).alias("a"))
    return a.select("conv_id", "turn", "a.status", "a.sql", "a.error", "a.summary")


@check(
    "conv_id bigint, turn bigint, status string, sql string, error string, unanswerable boolean",
    f"""WITH {TURNS} SELECT conv_id, turn, CASE k % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'completed' WHEN 2 THEN 'escalated' ELSE 'completed' END AS status,
      CASE WHEN k % 4 IN (1, 2) THEN 'select ' || k END AS sql,
      CASE k % 4 WHEN 0 THEN 'agent tool error: ' || substr(text, 1, 1000) WHEN 2 THEN 'late' END AS error, k % 4 = 2 AS unanswerable FROM v""",
)
def tool_replies(t: Tables) -> DataFrame:
    """Tool replies as status, SQL and error: an error block, JSON in a text block, or neither."""
    k = F.col("k") % 4
    sql = F.concat(F.lit("select "), F.col("k").cast("string"))
    block = lambda text: F.array(F.struct(F.lit("image").alias("type"), F.lit("-").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text")))
    answer = F.to_json(F.struct(sql.alias("sql_query"), F.lit("t1").alias("trace_id")))
    escalated = F.to_json(F.struct(sql.alias("sql_query"), F.lit("escalated").alias("status"), F.lit("late").alias("error"), F.lit(True).alias("is_unanswerable")))
    reply = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.lit(True).alias("isError"), block(F.col("text")).alias("content")).alias("result"))))
        .when(k == 1, F.to_json(F.struct(F.struct(block(answer).alias("content")).alias("result"))))
        .when(k == 2, F.to_json(F.struct(F.struct(block(escalated).alias("content")).alias("result"))))
        .otherwise(F.to_json(F.struct(F.struct(block(F.col("text")).alias("content")).alias("result"))))
    )
    m = turns(t).withColumn("reply", reply).select("conv_id", "turn", R.map_reply(F.col("reply")).alias("m"))
    return m.select("conv_id", "turn", "m.status", "m.sql", "m.error", F.col("m.is_unanswerable").alias("unanswerable"))


@check(
    "conv_id bigint, turn bigint, reason string",
    f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN k % 3 = 0 THEN 'agent_gave_no_answer: rejected' || CASE WHEN k % 2 = 0 THEN ' (none of the agent''s SQL ran)' ELSE '' END
      WHEN k % 3 = 1 THEN 'agent_found_the_question_unanswerable' ELSE 'agent_did_not_produce_sql' END AS reason FROM v""",
)
def reasons_without_sql(t: Tables) -> DataFrame:
    """Why an agent gave no SQL."""
    k = F.col("k")
    return turns(t).select(
        "conv_id", "turn",
        R.no_sql_reason(F.when(k % 3 == 0, "rejected"), k % 2 == 1, k % 3 == 1).alias("reason"),
    )


@check(
    "conv_id bigint, turn bigint, readable boolean, yes boolean, confidence bigint, reasoning string, n bigint",
    f"""WITH {TURNS} SELECT conv_id, turn, k % 5 < 4 AS readable, CASE WHEN k % 5 < 4 THEN k % 2 = 0 END AS yes,
      CASE k % 5 WHEN 0 THEN 85 WHEN 1 THEN 70 WHEN 2 THEN NULL WHEN 3 THEN 90 END AS confidence,
      CASE WHEN k % 5 < 4 THEN regexp_replace(regexp_replace(text, '^[\\s]+', ''), '[\\s]+$', '') END AS reasoning,
      CASE WHEN k % 5 = 0 THEN 2 WHEN k % 5 < 4 THEN 0 END AS n FROM v""",
)
def judge_verdicts(t: Tables) -> DataFrame:
    """Verdicts read from replies with thinking blocks, text around the JSON, and texts for booleans."""
    k = F.col("k") % 5
    yes = F.col("k") % 2 == 0
    as_text = F.when(yes, " Yes ").otherwise("no")
    why = F.concat(F.lit(" "), F.col("text"), F.lit("\n"))
    reply = (
        F.when(k == 0, F.concat(F.lit("<think>{not this}</think> Sure: "), F.to_json(F.struct(as_text.alias("is_false_negative"), F.lit("85%").alias("confidence"), why.alias("reasoning"), F.array(F.lit("a"), F.lit("b")).alias("key_differences"))), F.lit(" ok")))
        .when(k == 1, F.to_json(F.struct(yes.alias("is_false_negative"), F.lit(70.9).alias("confidence"), why.alias("reasoning"), F.lit("none").alias("key_differences"))))
        .when(k == 2, F.to_json(F.struct(yes.alias("is_false_negative"), F.lit("high").alias("confidence"), why.alias("reasoning"))))
        .when(k == 3, F.concat(F.lit("```json\n"), F.to_json(F.struct(yes.alias("is_false_negative"), F.lit(90).alias("confidence"), why.alias("reasoning"))), F.lit("\n```")))
        .otherwise(F.lit("{\"verdict\": 1}"))
    )
    p = turns(t).withColumn("reply", reply).select("conv_id", "turn", R.parse_verdict(F.col("reply")).alias("p"))
    return p.select(
        "conv_id", "turn", F.col("p").isNotNull().alias("readable"), F.col("p.is_false_negative").alias("yes"), "p.confidence", "p.reasoning",
        F.when(F.col("p").isNotNull(), F.size("p.key_differences")).alias("n"),
    )


@check(
    "conv_id bigint, turn bigint, decision boolean, reason string",
    f"""WITH {TURNS} SELECT conv_id, turn, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS decision,
      CASE k % 5 WHEN 0 THEN 'ranked' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END AS reason FROM v""",
)
def order_decisions(t: Tables) -> DataFrame:
    """Does the question ask for an order? Read from JSON, else from the words."""
    k = F.col("k") % 5
    reply = (
        F.when(k == 0, '<think>hm</think>{"requires_order": "true", "reason": " ranked "}')
        .when(k == 1, 'A: {"requires_order": false} done')
        .when(k == 2, 'I say requires_order: TRUE here')
        .when(k == 3, '"requires_order": false, {')
        .otherwise(F.concat(F.lit("unsure "), F.col("role")))
    )
    d = turns(t).withColumn("reply", reply).select("conv_id", "turn", R.parse_decision(F.col("reply")).alias("d"))
    return d.select("conv_id", "turn", F.col("d.requires_order").alias("decision"), "d.reason")


# ---------------------------------------------------------------- overlay and batches

@check(
    "case_id bigint, evaluator string, score double, passed boolean, applicable boolean, reason string, original string",
    """WITH b AS (SELECT doc_id AS c, n_chars % 2 = 1 AS ok, doc_id % 9 = 8 AS na, doc_id % 5 = 4 AS not_run, doc_id % 4 AS v FROM documents),
    a AS (SELECT *, NOT ok AND NOT na AS asked, NOT ok AND NOT na AND NOT not_run AND v IN (0, 1) AS over FROM b)
    SELECT c AS case_id, 'contains_accuracy' AS evaluator, CASE WHEN na THEN 0.0 WHEN ok OR over THEN 1.0 ELSE 0.0 END AS score, NOT na AND (ok OR over) AS passed,
      NOT na AS applicable, CASE WHEN NOT ok THEN 'row_count_mismatch' END AS reason, CASE WHEN over THEN '0.0' END AS original FROM a
    UNION ALL SELECT c, 'llm_judge', CASE WHEN over THEN 1.0 ELSE 0.0 END, over, NOT not_run AND v <> 3,
      CASE WHEN not_run THEN 'generated_sql_did_not_run' WHEN v = 3 THEN 'judge_unavailable' END, NULL FROM a WHERE asked""",
)
def judge_overlay(t: Tables) -> DataFrame:
    """A confident judge overturns a failed contains check and leaves a row of its own."""
    d = F.col("doc_id")
    docs = t.documents.select(
        d.alias("case_id"), (F.col("n_chars") % 2 == 1).alias("ok"), (d % 9 == 8).alias("na"), (d % 5 != 4).alias("generated_ok"),
        F.lit(True).alias("expected_ok"), (d % 4).alias("v"),
    )
    results = result(docs, "contains_accuracy", F.col("ok").cast("double"), ~F.col("na"), F.when(~F.col("ok"), "row_count_mismatch"))
    verdicts = docs.filter("v < 3").select(
        "case_id", F.lit(True).alias("is_false_negative"), F.when(F.col("v") == 2, 79).otherwise(80).alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    out = J.judge_overlay(results, docs, verdicts)
    return out.withColumn("original", F.try_element_at("details", F.lit("original_score")))


KEY_SQL = "sha256('m' || chr(0) || 'p' || chr(0) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


@check(
    "key string, n bigint, decision boolean, source string",
    f"""WITH n AS (SELECT {KEY_SQL} AS key, count(*) AS n, min(doc_id) AS a FROM documents GROUP BY 1)
    SELECT key, n, CASE WHEN a % 2 = 0 THEN a % 4 = 0 END AS decision, CASE WHEN a % 2 = 0 THEN 'cache' ELSE 'unavailable' END AS source FROM n""",
)
def saved_decisions(t: Tables) -> DataFrame:
    """Questions, here whole texts, joined to the decision saved under their key."""
    padded = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" \t"), "text", F.lit("\n"))).otherwise(F.col("text"))
    q = t.documents.select(J.request_key("m", "p", padded).alias("key"), "doc_id")
    per_key = q.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"))
    saved = per_key.filter(F.col("a") % 2 == 0).select("key", (F.col("a") % 4 == 0).alias("requires_order"))
    return J.decided(per_key, saved).withColumnRenamed("requires_order", "decision")


@check(
    "key string, prompt string",
    f"""WITH n AS (SELECT {KEY_SQL} AS key, any_value(text) AS q FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
    SELECT key, 'Q: ' || q || chr(10) || '/no_think' AS prompt FROM n
    WHERE key NOT IN (SELECT {KEY_SQL} FROM documents WHERE doc_id % 3 = 0)""",
)
def request_batch(t: Tables) -> DataFrame:
    """One request per text that nobody decided yet."""
    asked = t.documents.select(J.request_key("m", "p", F.col("text")).alias("key"), "text", "doc_id")
    saved = asked.filter("doc_id % 3 = 0").select("key").distinct()
    batch = J.request_batch(J.undecided(asked.filter("doc_id % 3 <> 0"), saved), "Qwen-3", F.concat(F.lit("Q: "), F.col("text")))
    return batch.select("key", F.get_json_object("request", "$.messages[0].content").alias("prompt"))


@check(
    "key bigint, requires_order boolean",
    """WITH s AS (SELECT doc_id AS key, quality = 1 AS r FROM labels WHERE doc_id % 2 = 0), f AS (SELECT doc_id AS key, toxic = 1 AS r FROM labels WHERE doc_id % 3 = 0 AND quality = 1)
    SELECT key, r AS requires_order FROM s UNION ALL SELECT key, r FROM f WHERE key NOT IN (SELECT key FROM s)""",
)
def added_decisions(t: Tables) -> DataFrame:
    """New decisions beside the saved ones; unreadable replies are not kept."""
    saved = t.labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("requires_order"))
    new = t.labels.filter("doc_id % 3 = 0").select(
        F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("requires_order")
    )
    return J.add_decisions(saved, new)


@check(
    "case_id bigint, shown string, shape string, key_characteristic string",
    """WITH o AS (SELECT p_size AS c, p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_size) AS n FROM part),
    l AS (SELECT c, n, pos, p_partkey || ' | ' || CASE WHEN length(repeat(p_name || ' ', 9)) > 80 THEN substr(repeat(p_name || ' ', 9), 1, 79) || '…' ELSE repeat(p_name || ' ', 9) END
      || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN 'NULL' ELSE p_brand END AS line FROM o WHERE pos < 50)
    SELECT c AS case_id, 'key | name | brand' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || CASE WHEN any_value(n) > 50 THEN chr(10) || '... ' || (any_value(n) - 50) || ' more rows not shown' ELSE '' END AS shown,
      any_value(n) || ' rows x 3 columns' AS shape, 'columns: key, name, brand' AS key_characteristic FROM l GROUP BY c""",
)
def result_as_text(t: Tables) -> DataFrame:
    """A result as a pipe table with its first fifty rows, and its summary."""
    from checks.tables import parts_by_size

    rows, shapes = parts_by_size(t)
    tables = J.result_tables(rows, shapes, ["case_id"]).withColumnRenamed("table", "shown")
    return tables.join(J.summaries(shapes, ["case_id"]), "case_id")


@check(
    "doc_id bigint, text string",
    """SELECT doc_id, substr('row count mismatch (expected_rows: ' || n_chars || ', note: ' || text || ')', 1, 1500) AS text FROM documents""",
)
def failure_texts(t: Tables) -> DataFrame:
    """A failure in words with its details, at most 1500 characters."""
    details = F.create_map(F.lit("note"), F.col("text"), F.lit("expected_rows"), F.col("n_chars").cast("string"), F.lit("reason"), F.lit("x"))
    return t.documents.select("doc_id", J.failure_text(F.lit("row_count_mismatch"), details).alias("text"))


@check(
    "doc_id bigint, prompt string",
    """SELECT doc_id, 'Question: ' || text || chr(10) || 'Rows ' || n_chars || ' and ' || n_chars || ', {{other}}' || ' {{user_question}} end' AS prompt FROM documents""",
)
def filled_prompts(t: Tables) -> DataFrame:
    """A prompt template filled in; values are not read as templates."""
    template = F.lit("Question: {{user_question}}\nRows {{expected_row_count}} and {{ expected_row_count }}, {{other}} {{failure_analysis}} end")
    values = {"user_question": F.col("text"), "expected_row_count": F.col("n_chars"), "failure_analysis": F.lit("{{user_question}}")}
    return t.documents.select("doc_id", J.fill_prompt(template, values).alias("prompt"))

"""Live state: the events table as the events of running jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Tables, check
from tallygrade.session import shared_folder
from tallygrade.streaming import live


def stream(t: Tables) -> DataFrame:
    """The events file read as a stream, with TIMESTAMP times."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.col("event_id"))


def in_batches(t: Tables, batches: int = 3) -> DataFrame:
    """The events as a stream of several micro-batches, each with rows from all over the table and files for all cores."""
    path = f"{shared_folder(t.spark)}/events-{uuid.uuid4().hex}"
    files = t.spark.sparkContext.defaultParallelism
    t.events.repartition(batches * files, F.xxhash64("event_id")).write.parquet(path)
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.col("event_id"))


def batch(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.col("event_id"))


def totals_of(df: DataFrame) -> DataFrame:
    """The final table of a streaming aggregate with few rows (one per run)."""
    name = f"live_{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def appended(df: DataFrame) -> DataFrame:
    """The rows an append stream wrote."""
    root = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    live.continue_load(df, f"{root}/out", f"{root}/checkpoint")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def run_events(e: DataFrame) -> DataFrame:
    return e.select(
        (F.col("user_id") % 10).alias("run_id"), (F.col("event_id") % 700).alias("case_id"),
        F.when(F.col("event_type") == "purchase", "case_done").otherwise("note").alias("event"),
        (F.col("event_id") % 1000).alias("total"), "ts", "seq",
    )


@check(
    "run_id bigint, completed bigint, total bigint",
    "SELECT user_id % 10 AS run_id, count_if(event_type = 'purchase') AS completed, max(event_id % 1000) AS total FROM events GROUP BY 1",
)
def live_progress(t: Tables) -> DataFrame:
    """Completed and total items per run, as a stream."""
    return totals_of(live.progress(run_events(stream(t))))


@check("run_id bigint, case_id bigint", "SELECT DISTINCT user_id % 10 AS run_id, event_id % 700 AS case_id FROM events WHERE event_type = 'purchase'")
def live_finished_cases(t: Tables) -> DataFrame:
    """Finished cases as they come, each once, as a stream."""
    return appended(live.finished_cases(run_events(stream(t)))).select("run_id", "case_id")


@check(
    "run_id bigint, case_id bigint, seq bigint",
    """SELECT user_id % 10 AS run_id, event_id % 700 AS case_id, CAST(first(event_id ORDER BY event_id % 2, ts, event_id) AS BIGINT) AS seq
    FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""",
)
def cases_written_once(t: Tables) -> DataFrame:
    """Finished cases over two calls of a load that keeps no keys: what the sink holds does not come again."""
    root = f"{shared_folder(t.spark)}/once-{uuid.uuid4().hex}"
    for call in (0, 1):
        t.events.filter(F.col("event_id") % 2 == call).write.mode("append").parquet(f"{root}/in")
        raw = t.spark.readStream.schema(t.events.schema).parquet(f"{root}/in")
        events = run_events(raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.col("event_id")))
        done = events.filter(F.col("event") == "case_done")
        live.continue_load(live.not_written(done, ["run_id", "case_id"], f"{root}/out"), f"{root}/out", f"{root}/checkpoint")
    return live.written_once(done, ["run_id", "case_id"], f"{root}/out").select("run_id", "case_id", "seq")


@check(
    "run_id bigint, evaluator string, average double, evaluated bigint",
    """SELECT user_id % 10 AS run_id, event_type AS evaluator, coalesce(CAST(format('{:.4f}', avg(CASE WHEN event_id % 3 > 0 THEN (event_id % 2)::DOUBLE END)) AS DOUBLE), 0) AS average,
    count_if(event_id % 3 > 0) AS evaluated FROM events GROUP BY ALL""",
)
def live_averages(t: Tables) -> DataFrame:
    """Running averages per evaluator, as a stream."""
    results = stream(t).select(
        (F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("evaluator"),
        (F.col("event_id") % 2).cast("double").alias("score"), (F.col("event_id") % 3 > 0).alias("applicable"),
    )
    return totals_of(live.running_averages(results))


WAITS = """w AS (SELECT user_id AS q, event_id AS s, CASE event_type WHEN 'click' THEN 'wait_start' WHEN 'view' THEN 'wait_end' WHEN 'error' THEN CASE WHEN event_id % 40 < 20 THEN 'stop' ELSE 'note' END ELSE 'note' END AS ev,
  CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'llm_judge' END AS stage, event_id % 3 + 1 AS retry FROM events)"""


def wait_events(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "click", "wait_start").when(kind == "view", "wait_end")
        .when((kind == "error") & (F.col("event_id") % 40 < 20), "stop").otherwise("note")
    )
    return e.select(
        F.col("user_id").alias("question_id"), event.alias("event"),
        F.when(F.col("event_id") % 2 == 0, "agent").otherwise("llm_judge").alias("stage"),
        (F.col("event_id") % 3 + 1).alias("retry"), F.lit("busy").alias("error"), "ts", "seq",
    )


@check(
    "question_id bigint, waiting boolean, stage string, retry bigint, retries bigint, stopped boolean, stop_refused boolean",
    f"""WITH {WAITS}, g AS (SELECT q, arg_max(ev, s) FILTER (ev LIKE 'wait%') AS last_ev, arg_max(stage, s) FILTER (ev LIKE 'wait%') AS st, arg_max(retry, s) FILTER (ev LIKE 'wait%') AS r,
      count_if(ev = 'wait_start') AS n, min(s) FILTER (ev = 'wait_start') AS f, max(s) FILTER (ev = 'stop') AS stop, max(s) FILTER (ev LIKE 'wait%') AS lw FROM w GROUP BY q),
    x AS (SELECT *, coalesce(stop > f, false) AS stopped, coalesce(last_ev = 'wait_start', false) AND NOT coalesce(stop > f AND stop > lw, false) AS waiting FROM g)
    SELECT q AS question_id, waiting, CASE WHEN waiting THEN st END AS stage, CASE WHEN waiting THEN r END AS retry, n AS retries, stopped,
      stop IS NOT NULL AND NOT stopped AS stop_refused FROM x""",
)
def questions_waiting(t: Tables) -> DataFrame:
    """Which questions wait out a rate limit, and which stops count, as a stream of three micro-batches."""
    return live.newest(appended(live.waits_log(wait_events(in_batches(t)))), "question_id")


@check(
    "question_id bigint, agent bigint, judge bigint, total bigint",
    f"""WITH {WAITS} SELECT q AS question_id, nullif(count_if(stage = 'agent'), 0) AS agent, nullif(count_if(stage = 'llm_judge'), 0) AS judge, count(*) AS total FROM w WHERE ev = 'wait_start' GROUP BY q""",
)
def retries_per_stage(t: Tables) -> DataFrame:
    """Retries of each question by stage."""
    r = live.retries_by_stage(wait_events(batch(t)))
    at = lambda k: F.try_element_at("retries", F.lit(k))
    return r.select("question_id", at("agent").alias("agent"), at("llm_judge").alias("judge"), "total")


@check(
    "question_id bigint, stage string, failures bigint, outcome string, retry_at string, label string",
    """WITH f AS (SELECT event_id // 7 AS q, event_type AS stage, {'t': ts, 's': event_id} AS mo, event_id % 11 = 0 AS stop, 'busy ' || event_id AS err FROM events),
    b AS (SELECT q, min(mo) AS first FROM f WHERE NOT stop GROUP BY q),
    h AS (SELECT q, min(mo) AS st FROM f JOIN b USING (q) WHERE stop AND mo > first GROUP BY q),
    g AS (SELECT q, stage, count(*) AS n, max(mo) AS la, arg_max(err, mo) AS err FROM f WHERE NOT stop GROUP BY ALL),
    r AS (SELECT g.*, st, la.t + to_seconds(CAST(20 * pow(2, n - 1) AS BIGINT)) AS r FROM g LEFT JOIN h USING (q)),
    o AS (SELECT *, CASE WHEN st < la THEN 'stopped' WHEN n > 2 THEN 'exhausted' WHEN st.t < r THEN 'stopped' ELSE 'retry' END AS outcome FROM r)
    SELECT q AS question_id, stage, n AS failures, outcome, CASE WHEN outcome = 'retry' THEN strftime(r, '%Y-%m-%d %H:%M:%S') END AS retry_at,
      CASE outcome WHEN 'stopped' THEN 'rate_limited: ' || stage || ' (retries stopped by the user)'
        WHEN 'exhausted' THEN 'rate_limited: ' || stage || ' (still rate limited after 2 retries: ' || err || ')' END AS label FROM o""",
)
def retry_plans(t: Tables) -> DataFrame:
    """What follows a rate-limited call: another try at a time, or giving up; as a stream of three micro-batches."""
    failures = in_batches(t).select(
        F.floor(F.col("event_id") / 7).alias("question_id"), F.col("event_type").alias("stage"),
        F.concat(F.lit("busy "), F.col("event_id").cast("string")).alias("error"), "ts", "seq", (F.col("event_id") % 11 == 0).alias("stop"),
    )
    plans = live.retries_of(appended(live.retry_log(failures, max_retries=2)), max_retries=2)
    return plans.withColumn("retry_at", F.date_format("retry_at", "yyyy-MM-dd HH:mm:ss"))


def job_events(e: DataFrame) -> DataFrame:
    k = F.col("event_id") % 97
    status = F.when(k == 5, "completed").when(k == 7, "failed").otherwise("running")
    return e.select(
        F.col("user_id").alias("job_id"), status.alias("status"), F.when(k == 7, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), "ts", "seq"
    )


JOBS = """j AS (SELECT user_id AS job, event_id AS s, ts, CASE event_id % 97 WHEN 5 THEN 'completed' WHEN 7 THEN 'failed' ELSE 'running' END AS st,
  CASE WHEN event_id % 97 = 7 THEN 'e' || event_id END AS err FROM events),
js AS (SELECT job, arg_max(st, s) AS status, arg_max_null(err, s) FILTER (st <> 'running') AS error, min(ts) AS created, max(ts) FILTER (st <> 'running') AS finished FROM j GROUP BY job)"""


@check(
    "job_id bigint, status string, error string, created_at string, finished_at string",
    f"WITH {JOBS} SELECT job AS job_id, status, error, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(finished, '%Y-%m-%d %H:%M:%S.%f') AS finished_at FROM js",
)
def job_states(t: Tables) -> DataFrame:
    """The newest status of each job, its error and times, as a stream that frees the state of finished jobs."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    log = appended(live.jobs_log(job_events(in_batches(t)), late="3650 days"))  # the batches are dealt at random: nothing is too late
    return live.jobs_of(log).select("job_id", "status", "error", shown("created_at"), shown("finished_at"))


@check(
    "job_id bigint, status string",
    """WITH d AS (SELECT event_id AS job_id, ts, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'completed' END AS status FROM events)
    SELECT job_id, status FROM d WHERE status = 'running' UNION ALL SELECT job_id, status FROM (SELECT * FROM d WHERE status <> 'running' ORDER BY ts DESC, job_id DESC LIMIT 200)""",
)
def jobs_kept(t: Tables) -> DataFrame:
    """All running jobs and the 200 newest finished ones."""
    status = F.when(F.col("event_id") % 3 == 0, "running").otherwise("completed")
    return live.kept_jobs(batch(t).select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), status.alias("status")))


@check(
    "event_type string, n bigint, last bigint",
    """WITH f AS (SELECT event_type, event_id, event_id % 3 = 2 AS late FROM events), d AS (SELECT event_type FROM f GROUP BY 1 HAVING event_type = 'click')
    SELECT event_type, count(*) AS n, max(event_id) AS last FROM f WHERE NOT late OR event_type NOT IN (SELECT event_type FROM d) GROUP BY 1""",
)
def continued_load(t: Tables) -> DataFrame:
    """A load that goes on where it stopped: the second call loads new files, but nothing of a table that is done."""
    root = f"{shared_folder(t.spark)}/load-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "event_type")
    late = F.col("event_id") % 3 == 2
    new = lambda: t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    load = lambda: live.load_tables(new(), f"{root}/out", f"{root}/checkpoint", f"{root}/done", "event_type", "event_id")
    rows.filter(~late).write.parquet(f"{root}/in")
    first = load()
    clicks = rows.filter(~late & (F.col("event_type") == "click")).groupBy("event_type").agg(F.count("*").alias("total"))
    live.mark_done(first, clicks, f"{root}/done", "event_type")
    rows.filter(late).write.mode("append").parquet(f"{root}/in")
    return load().select("event_type", F.col("rows").alias("n"), "last")


@check(
    "key bigint, value string",
    "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR",
)
def fresh_cache_entries(t: Tables) -> DataFrame:
    """The newest cached value per key, unless it is too old."""
    entries = batch(t).select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", "seq")
    now = entries.agg(F.max("ts")).first()[0]  # the time of the last event stands for the clock
    return live.fresh_entries(entries, F.lit(now), 6 * 3600)


@check(
    "key bigint, ts string",
    """WITH RECURSIVE l AS (SELECT user_id AS key, min(ts) AS ts FROM events GROUP BY 1
      UNION ALL SELECT l.key, min(e.ts) FROM l JOIN events e ON e.user_id = l.key AND e.ts >= l.ts + INTERVAL 90 MINUTE GROUP BY l.key)
    SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM l""",
)
def keys_loaded_once(t: Tables) -> DataFrame:
    """Each key is loaded once per time to live, as a stream."""
    asked = stream(t).select(F.col("user_id").alias("key"), "ts")
    loads = appended(live.loads_in_ttl(asked, 90 * 60))
    return loads.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@check("key string", "SELECT DISTINCT event_type || user_id AS key FROM events WHERE user_id % 5 <> 0")
def new_question_keys(t: Tables) -> DataFrame:
    """Question keys nobody decided yet, each once, as a stream joined to a table."""
    keyed = lambda e: e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "ts", "user_id")
    saved = keyed(batch(t)).filter("user_id % 5 = 0").select("key").distinct()
    return appended(live.new_decisions(keyed(stream(t)), saved)).select("key")

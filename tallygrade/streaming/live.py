"""The state of running jobs as Structured Streaming queries over their events.

Events carry a TIMESTAMP `ts` and a sequence number `seq`; state is one small
row per job, question or key. The same functions work on a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrade.functions.figures import rate_limit_label, retry_delay, rounded

# Fixed values.
CACHE_SECONDS = 600
KEPT_JOBS = 200
MAX_RETRIES = 3
WAIT_SECONDS = 20.0
#: Groups of keys whose states are kept together where no state is freed, and the types of keys that can be.
GROUPS = 1 << 14
NAMES = ("tinyint", "smallint", "int", "bigint", "string")


def _latest(value: Column) -> Column:
    return F.max_by(value, F.struct("ts", "seq"))


def progress(events: DataFrame) -> DataFrame:
    """Completed and total items per run. events: run_id, event, total."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("event") == "case_done").alias("completed"), F.max("total").alias("total")
    )


def once_each(rows: DataFrame, keys: list[str], late: str | None) -> DataFrame:
    """The first row of each key.

    late None keeps the keys of the whole stream, so that none is lost or comes twice. A
    duration bounds what is kept: rows that come later than that are dropped, and a key
    can come again after it.
    """
    if rows.isStreaming and late is not None:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def finished_cases(events: DataFrame, late: str | None = None) -> DataFrame:
    """Cases as they finish, once each. events: run_id, case_id, event, ts, ..."""
    return once_each(events.filter(F.col("event") == "case_done"), ["run_id", "case_id"], late)


def running_averages(results: DataFrame) -> DataFrame:
    """Average and count per run and evaluator so far; not-applicable results do not count."""
    kept = F.when(F.col("applicable"), F.col("score"))
    return results.groupBy("run_id", "evaluator").agg(
        F.coalesce(rounded(F.avg(kept), 4), F.lit(0.0)).alias("average"), F.count(kept).alias("evaluated")
    )


def question_waits(events: DataFrame) -> DataFrame:
    """Where each question stands with the rate limit.

    events: question_id, event (wait_start, wait_end, stop, ...), stage, retry,
    error, ts, seq. The newest start or end decides if it waits; a stop counts only
    once the question has waited or retried, and ends the wait.
    """
    is_wait = F.col("event").isin("wait_start", "wait_end")
    at = F.struct("ts", "seq")
    newest = F.max_by(F.struct("event", "stage", "retry", "error", "ts"), F.when(is_wait, at))
    started = F.min(F.when(F.col("event") == "wait_start", at))
    last_stop = F.max(F.when(F.col("event") == "stop", at))
    last_wait = F.max(F.when(is_wait, at))
    grouped = events.groupBy("question_id").agg(
        newest.alias("w"),
        F.count_if(F.col("event") == "wait_start").alias("retries"),
        started.alias("_first"),
        last_stop.alias("_stop"),
        last_wait.alias("_wait"),
    )
    stopped = F.coalesce(F.col("_stop") > F.col("_first"), F.lit(False))
    refused = F.col("_stop").isNotNull() & ~stopped
    ended = stopped & F.coalesce(F.col("_stop") > F.col("_wait"), F.lit(False))
    waiting = F.coalesce(F.col("w.event") == "wait_start", F.lit(False)) & ~ended
    return grouped.select(
        "question_id",
        waiting.alias("waiting"),
        F.when(waiting, F.col("w.stage")).alias("stage"),
        F.when(waiting, F.col("w.retry")).alias("retry"),
        "retries",
        stopped.alias("stopped"),
        refused.alias("stop_refused"),
    )


def retry_plan(failures: DataFrame, max_retries: int = MAX_RETRIES,
               wait_seconds: float = WAIT_SECONDS) -> DataFrame:
    """Per question and stage what follows its last rate-limited call.

    failures: question_id, stage, error, ts, seq, and stop BOOLEAN (a user's stop).
    The n-th failure is followed by retry n after base * 2^(n-1) seconds, until there are none left or the user
    stopped. A stop counts once its question has failed, for all its stages: it ends a wait that it falls in, and a
    later failure is not retried. One before the first failure is refused; one after the last wait changes nothing.
    """
    at = F.struct("ts", "seq")
    calls = failures.filter(~F.col("stop"))
    first = calls.groupBy("question_id").agg(F.min(at).alias("_first"))
    halted = failures.filter("stop").select("question_id", at.alias("_at")).join(first, "question_id").filter("_at > _first")
    halted = halted.groupBy("question_id").agg(F.min("_at").alias("_stop"))
    if max_retries < 1:  # nothing ever waits
        halted = halted.filter("false")
    grouped = calls.groupBy("question_id", "stage").agg(
        F.count("*").alias("failures"), F.max(at).alias("_last"), F.max_by("error", at).alias("error")
    ).join(halted, "question_id", "left")
    retry_at = F.col("_last.ts") + F.make_dt_interval(secs=retry_delay(F.col("failures"), wait_seconds).cast("decimal(18,6)"))
    stopped = lambda until: F.coalesce(F.col("_stop") < until, F.lit(False))
    outcome = (
        F.when(stopped(F.col("_last")), "stopped")
        .when(F.col("failures") > max_retries, "exhausted")
        .when(F.coalesce(F.col("_stop.ts") < retry_at, F.lit(False)), "stopped")
        .otherwise("retry")
    )
    return grouped.select(
        "question_id",
        "stage",
        "failures",
        outcome.alias("outcome"),
        F.when(outcome == "retry", retry_at).alias("retry_at"),
        rate_limit_label(F.col("stage"), outcome, F.col("error"), max_retries).alias("label"),
    )


def retries_by_stage(events: DataFrame) -> DataFrame:
    """Per question the MAP from stage to retries."""
    per = (
        events.filter(F.col("event") == "wait_start")
        .groupBy("question_id", "stage")
        .agg(F.count("*").alias("n"))
    )
    return per.groupBy("question_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("retries"),
        F.sum("n").alias("total"),
    )


def job_status(events: DataFrame) -> DataFrame:
    """Per job: newest status, its error, when it was created and finished."""
    over = F.col("status").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        _latest(F.col("status")).alias("status"),
        F.max_by("error", F.when(over, F.struct("ts", "seq"))).alias("error"),
        F.min("ts").alias("created_at"),
        F.max(F.when(over, F.col("ts"))).alias("finished_at"),
    )


def kept_jobs(jobs: DataFrame, newest: int = KEPT_JOBS) -> DataFrame:
    """All running jobs and the newest finished ones.

    Every task keeps its own newest few and only those meet (top-k), so the
    finished jobs are not ranked in one task.
    """
    running = jobs.filter(F.col("status") == "running")
    finished = jobs.filter(F.col("status") != "running")
    top = finished.orderBy(F.desc("created_at"), F.desc("job_id")).limit(newest)
    return running.unionByName(top)


def fresh_entries(entries: DataFrame, now: Column, ttl_seconds: int = CACHE_SECONDS) -> DataFrame:
    """Cache with a time to live: the newest value per key that is not too old."""
    newest = entries.groupBy("key").agg(_latest(F.col("value")).alias("value"), F.max("ts").alias("ts"))
    return newest.filter(F.col("ts") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def loads_in_ttl(asked: DataFrame, ttl_seconds: int = CACHE_SECONDS) -> DataFrame:
    """Stream form of the cache: (key, ts) of every load.

    asked: key, ts. A key is loaded when it is asked for first, and again by the first
    request at or after the end of its time to live. The state of a key is the time of its
    last load; requests before that are served by it, however late they come.
    """
    fields = {f.name: f.dataType.simpleString() for f in asked.schema.fields}

    def load(key, parts, state):
        import pandas as pd

        life = pd.Timedelta(seconds=ttl_seconds)
        last = pd.Timestamp(state.get[0]) if state.exists else None
        times = pd.concat([p["ts"] for p in parts]).sort_values(ignore_index=True)
        loads = []
        while True:
            at = 0 if last is None else int(times.searchsorted(last + life))
            if at >= len(times):
                break
            last = times.iloc[at]
            loads.append(last)
        if loads:
            state.update((loads[-1].to_pydatetime(),))
            yield pd.DataFrame({"key": [key[0]] * len(loads), "ts": loads})

    return asked.select("key", "ts").groupBy("key").applyInPandasWithState(
        load, f"key {fields['key']}, ts {fields['ts']}", f"ts {fields['ts']}", "append", "NoTimeout"
    )


def new_decisions(questions: DataFrame, saved: DataFrame, late: str | None = None) -> DataFrame:
    """Question keys that nobody decided yet, each once; saved decisions are a static table."""
    return once_each(questions.join(saved.select("key"), "key", "left_anti"), ["key"], late)


def folded(events: DataFrame, key: str, add: Callable[[dict, dict], None], shown: Callable[[dict], list[tuple]], out: str,
           ends: Callable[[dict], int | None] | None = None) -> DataFrame:
    """A log of a stream's state: (key, born, version, columns of out), the rows of each key that a micro-batch changed.

    add(state, event) takes one event into a key's state and must not depend on the order of events; shown(state) gives
    its rows. Times are microseconds in `at`. ends(state) says from which event time on a key's state may be freed; the
    events then need a watermark. `newest` reads the log. A key's events of one micro-batch meet in one task: bound a
    micro-batch at the source. The state is what add keeps, not the events. Without ends, keys of one hash in
    GROUPS share a call and a state: a call costs far more than a key.
    """
    kind = events.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in out.split(", ")]
    if ends is None and kind in NAMES:
        return _folded_together(events, key, kind, add, shown, names, out)

    def change(name, parts, state):
        import json

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {"born": state.getCurrentWatermarkMs() if ends else 0, "version": 0}
        for part in parts:
            for event in part.astype(object).where(part.notna(), None).to_dict("records"):
                add(now, event)
        now["version"] += 1
        state.update((json.dumps(now),))
        until = ends(now) if ends else None
        if until is not None:
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        rows = [(name[0], now["born"], now["version"], *row) for row in shown(now)]
        if rows:
            yield pd.DataFrame(rows, columns=[key, "born", "version", *names], dtype=object)

    timed = events.withColumn("at", F.unix_micros("ts"))
    timed = timed if ends else timed.drop("ts")
    return timed.groupBy(key).applyInPandasWithState(
        change, f"{key} {kind}, born long, version long, {out}", "text string", "append", "EventTimeTimeout" if ends else "NoTimeout"
    )


def _folded_together(events: DataFrame, key: str, kind: str, add: Callable[[dict, dict], None], shown: Callable[[dict], list[tuple]],
                     names: list[str], out: str) -> DataFrame:
    """`folded` with one state for each group of keys; an event goes along as JSON, which keeps long numbers beside nulls."""

    def change(_, parts, state):
        import json

        import pandas as pd

        held = dict(json.loads(state.get[0])) if state.exists else {}
        changed = {}
        for part in parts:
            for text in part["event"]:
                event = json.loads(text)
                name = event[key]
                if name not in changed:
                    changed[name] = held.setdefault(name, {"born": 0, "version": 0})
                add(changed[name], event)
        for now in changed.values():
            now["version"] += 1
        state.update((json.dumps(list(held.items())),))
        rows = [(name, now["born"], now["version"], *row) for name, now in changed.items() for row in shown(now)]
        if rows:
            yield pd.DataFrame(rows, columns=[key, "born", "version", *names], dtype=object)

    columns = [F.col(c) for c in events.columns if c != "ts"]
    event = F.to_json(F.struct(*columns, F.unix_micros("ts").alias("at")), {"ignoreNullFields": "false"})
    grouped = events.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"), event.alias("event")).groupBy("_group")
    return grouped.applyInPandasWithState(change, f"{key} {kind}, born long, version long, {out}", "text string", "append", "NoTimeout")


def newest(log: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last version in a log that `folded` wrote."""
    last = log.groupBy(key).agg(F.max(F.struct("born", "version")).alias("_last"))
    last = last.select(F.col(key).alias("_key"), "_last.born", "_last.version")
    same = F.col(key).eqNullSafe(F.col("_key"))
    return log.alias("l").join(last.alias("r"), same & (F.col("l.born") == F.col("r.born")) & (F.col("l.version") == F.col("r.version"))).select("l.*").drop("born", "version")


def waits_log(events: DataFrame) -> DataFrame:
    """`question_waits` over a stream: its state per question, merged by event time whatever order rows come in."""

    def add(state, event):
        at = [event["at"], event["seq"]]
        if event["event"] in ("wait_start", "wait_end"):
            if state.get("wait") is None or at > state["wait"]:
                state |= {"wait": at, "now": [event["event"], event["stage"], event["retry"]]}
            if event["event"] == "wait_start":
                state["retries"] = state.get("retries", 0) + 1
                state["first"] = min(at, state.get("first") or at)
        elif event["event"] == "stop":
            state["stop"] = max(at, state.get("stop") or at)

    def shown(state):
        first, stop, wait = state.get("first"), state.get("stop"), state.get("wait")
        stopped = bool(stop and first and stop > first)
        kind, stage, retry = state.get("now", (None, None, None))
        waiting = kind == "wait_start" and not (stopped and stop > wait)
        return [(waiting, stage if waiting else None, retry if waiting else None, state.get("retries", 0), stopped, bool(stop) and not stopped)]

    columns = events.select("question_id", "event", "stage", F.col("retry").cast("long").alias("retry"), "ts", "seq")
    return folded(columns, "question_id", add, shown, "waiting boolean, stage string, retry long, retries long, stopped boolean, stop_refused boolean")


def retry_log(failures: DataFrame, max_retries: int = MAX_RETRIES, wait_seconds: float = WAIT_SECONDS) -> DataFrame:
    """`retry_plan` over a stream: stages and stops of a question are one state, so that a stop meets all its stages.

    Of the stops only those are kept that can still count: up to the first failure, which may move back, and the first one after it.
    """

    def add(state, event):
        at = [event["at"], event["seq"]]
        stages, stops = state.setdefault("stages", {}), state.setdefault("stops", [])
        if event["stop"]:
            stops.append(at)
        else:
            known = stages.setdefault(event["stage"] or "", {"n": 0, "last": at, "error": event["error"]})
            known["n"] += 1
            if at >= known["last"]:
                known |= {"last": at, "error": event["error"]}
            state["first"] = min(at, state.get("first") or at)
        first = state.get("first")
        if first:
            stops.sort()
            state["stops"] = [s for s in stops if s <= first] + [s for s in stops if s > first][:1]

    def shown(state):
        first = state.get("first")
        stop = next((s for s in state["stops"] if first and s > first), None) if max_retries > 0 else None
        rows = []
        for stage, known in state["stages"].items():
            retry_at = known["last"][0] + round(wait_seconds * 2 ** (known["n"] - 1) * 1_000_000)
            if stop and stop < known["last"]:
                outcome = "stopped"
            elif known["n"] > max_retries:
                outcome = "exhausted"
            else:
                outcome = "stopped" if stop and stop[0] < retry_at else "retry"
            rows.append((stage, known["n"], outcome, retry_at if outcome == "retry" else None, known["error"]))
        return rows

    columns = failures.select("question_id", "stage", "error", "stop", "ts", "seq")
    return folded(columns, "question_id", add, shown, "stage string, failures long, outcome string, retry_micros double, error string")


def retries_of(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The plans that a retry log holds now, as `retry_plan` gives them."""
    at = F.timestamp_micros(F.col("retry_micros").cast("long"))
    label = rate_limit_label(F.col("stage"), F.col("outcome"), F.col("error"), max_retries)
    return newest(log, "question_id").select("question_id", "stage", "failures", "outcome", at.alias("retry_at"), label.alias("label"))


def jobs_log(events: DataFrame, late: str = "1 hour", kept_seconds: int = 3600) -> DataFrame:
    """`job_status` over a stream. The state of a job is freed kept_seconds of event time after it finished.

    Running jobs stay. Events more than `late` behind the newest are dropped. What a freed job was stays in the log;
    `kept_jobs` over it says which are still listed.
    """

    def add(state, event):
        at, status = [event["at"], event["seq"]], event["status"]
        if state.get("last") is None or at > state["last"]:
            state |= {"last": at, "status": status}
        if status in ("completed", "failed") and (state.get("over") is None or at > state["over"]):
            state |= {"over": at, "error": event["error"]}
        state["created"] = min(at[0], state.get("created", at[0]))

    def shown(state):
        over = state.get("over")
        return [(state["status"], state.get("error"), state["created"], over[0] if over else None)]

    def ends(state):
        return None if state["status"] == "running" else state["last"][0] + kept_seconds * 1_000_000

    columns = events.select("job_id", "status", "error", "ts", "seq").withWatermark("ts", late)
    return folded(columns, "job_id", add, shown, "status string, error string, created_micros long, finished_micros double", ends)


def jobs_of(log: DataFrame) -> DataFrame:
    """The jobs that a job log holds, as `job_status` gives them."""
    at = lambda c: F.timestamp_micros(F.col(c).cast("long"))
    return newest(log, "job_id").select("job_id", "status", "error", at("created_micros").alias("created_at"), at("finished_micros").alias("finished_at"))


def continue_load(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Load what came since the last call, then stop; the ended query tells about its progress.

    The file sink commits each batch in its log, so a batch that is tried again
    after a failure is not loaded twice.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def not_written(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Rows of a stream whose keys a file sink does not hold yet; no keys are kept in state, and none is too late.

    The sink is read when the call starts, so a key can be written again within one call: `written_once` reads
    the sink with each key once. Null keys are one key.
    """
    spark = rows.sparkSession
    if not _exists(spark, target):
        return rows
    known = spark.read.schema(rows.schema).parquet(target).select(F.struct(*keys).alias("_known")).distinct()
    return rows.join(known, F.struct(*[rows[k] for k in keys]) == F.col("_known"), "left_anti")


def written_once(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The rows that a sink of `not_written` holds, each key once: the first by (ts, seq)."""
    held = rows.sparkSession.read.schema(rows.schema).parquet(target)
    whole = F.struct(*[F.col(c) for c in held.columns])
    return held.groupBy(*keys).agg(F.min_by(whole, F.struct("ts", "seq")).alias("_row")).select("_row.*")


def load_tables(stream: DataFrame, target: str, checkpoint: str, marks: str, key: str, order: str) -> DataFrame:
    """Load rows that came since the last call, of tables that are not done; (key, rows, last) of what is loaded by now.

    marks is a folder of done marks (see `mark_done`): a table with a mark gets no more rows, whatever comes for
    it. The sink's log commits the rows of each batch, so the counts are those of committed rows.
    """
    spark = stream.sparkSession
    done = spark.createDataFrame([], f"{key} {stream.schema[key].dataType.simpleString()}") if not _exists(spark, marks) else spark.read.parquet(marks).select(key).distinct()
    continue_load(stream.join(done, key, "left_anti"), target, checkpoint)
    loaded = spark.read.schema(stream.schema).parquet(target)
    return loaded.groupBy(key).agg(F.count("*").alias("rows"), F.max(order).alias("last"))


def mark_done(progress: DataFrame, totals: DataFrame, marks: str, key: str) -> None:
    """Add a mark for each table of progress (key, rows, last) that has all its rows; totals: key, total."""
    whole = progress.join(totals, key).filter(F.col("rows") >= F.col("total"))
    whole.select(key, "rows", "last").write.mode("append").parquet(marks)


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

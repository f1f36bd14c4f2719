"""Run statistics as lists of aggregate columns, so one groupBy computes them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrade.functions.figures import rate, rounded

# Weight of each evaluator in the composite score.
WEIGHTS = {
    "execution_accuracy": 0.15,
    "contains_accuracy": 0.40,
    "sql_exact_match": 0.0,
    "time_shift": 0.25,
    "component_match": 0.10,
    "schema_validity": 0.05,
    "dialect_validity": 0.05,
}

# Failure categories, most urgent first.
FAILURES = (
    "agent_crash",
    "timeout",
    "sql_execution_failure",
    "trino_failure",
    "validation_failure",
)


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def succeeded() -> Column:
    """The agent finished with SQL and both queries ran; it says nothing about the score."""
    return yes("agent_ok") & yes("expected_ok") & yes("generated_ok")


def agent_ok(status: Column, sql: Column) -> Column:
    return F.coalesce((status == "completed") & sql.isNotNull(), F.lit(False))


def case_counts() -> list[Column]:
    """total_cases, passed, failed, failure_rate."""
    passed = F.count_if(succeeded())
    failed = F.count("*") - passed
    return [
        F.count("*").alias("total_cases"),
        passed.alias("passed"),
        failed.alias("failed"),
        rate(failed, F.count("*")).alias("failure_rate"),
    ]


def latency_bounds(value: Column, prefix: str, where: Column | None = None) -> list[Column]:
    """Mean, bounds (2 digits) and count; zeros when empty."""
    v = value if where is None else F.when(where, value)

    def shown(c: Column, name: str) -> Column:
        return F.coalesce(rounded(c.cast("double"), 2), F.lit(0.0)).alias(f"{prefix}_{name}")

    return [
        shown(F.avg(v), "average"),
        shown(F.min(v), "minimum"),
        shown(F.max(v), "maximum"),
        F.count(v).alias(f"{prefix}_samples"),
    ]


# Log-spaced buckets a value falls in: a few ten thousand for any range of latencies.
BUCKETS_PER_E = 1024


def percentiles(df: DataFrame, keys: list[str], value: Column, prefix: str,
                probabilities: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, per key.

    One key may hold most of the rows, so no task sorts or keeps a whole key:
    equal values are counted first, ranks are running sums inside log-spaced value
    buckets, and only the bucket totals of a key are added up in order.
    """
    probabilities = probabilities or {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    v = F.col("_v")
    counted = (
        df.select(*keys, value.cast("double").alias("_v"))
        .filter(v.isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_bucket", F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_E).cast("long")
        )
    )
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in"))
    totals = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("_total"),
    )
    ranked = (
        counted.withColumn("_within", F.sum("_n").over(upto))
        .join(totals, [*keys, "_bucket"])
        .withColumn("_rank", F.col("_within") + F.col("_before"))
    )

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_rank") > position, v))

    aggregates, shown = [], []
    for name, p in probabilities.items():
        spot = (F.col("_total") - 1) * F.lit(p)
        aggregates += [
            at(F.floor(spot)).alias(f"_{name}_low"),
            at(F.ceil(spot)).alias(f"_{name}_high"),
            F.max(spot - F.floor(spot)).alias(f"_{name}_part"),
        ]
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        shown.append(
            rounded(low + (high - low) * F.col(f"_{name}_part"), 2).alias(f"{prefix}_{name}")
        )
    return ranked.groupBy(*keys).agg(*aggregates).select(*keys, *shown)


def failure_category() -> Column:
    """First category that holds, NULL for a case without failure."""
    gold_failed = F.col("expected_ok") == F.lit(False)
    answer_failed = F.col("generated_ok") == F.lit(False)
    return (
        F.when(yes("agent_crashed"), FAILURES[0])
        .when(yes("timed_out"), FAILURES[1])
        .when(~yes("agent_answered") | (~yes("agent_ok") & ~yes("generated_ok")), FAILURES[2])
        .when(gold_failed | answer_failed, FAILURES[3])
        .when(~succeeded(), FAILURES[4])
    )


def failure_stats() -> list[Column]:
    """Count and rate per category and in total, in wide form."""
    category = failure_category()
    total = F.count(category)
    out = [
        total.alias("total_failures"),
        rate(total, F.count("*")).alias("total_failure_rate"),
    ]
    for name in FAILURES:
        n = F.count_if(category == name)
        out += [n.alias(f"{name}_count"), rate(n, F.count("*")).alias(f"{name}_rate")]
    return out


def failure_breakdown(cases: DataFrame, run: str = "run_id") -> DataFrame:
    """Long form: the categories that occur in a run, with count and rate."""
    per = cases.withColumn("category", failure_category()).groupBy(run, "category").agg(
        F.count("*").alias("n")
    )
    totals = per.groupBy(run).agg(F.sum("n").alias("_total"))
    return (
        per.filter(F.col("category").isNotNull())
        .join(totals, run)
        .select(run, "category", "n", rate(F.col("n"), F.col("_total")).alias("rate"))
    )


def performance_stats() -> list[Column]:
    """Execution time and time to first row (metadata, else the generated result's), tokens."""
    ran = F.when(yes("generated_ok"), F.col("generated_exec_ms"))

    def mean(meta: str) -> Column:
        return F.coalesce(rounded(F.avg(F.coalesce(F.col(meta), ran, F.lit(0.0))), 2), F.lit(0.0))

    tokens = F.coalesce(F.col("token_usage"), F.lit(0)).cast("long")
    return [
        mean("total_execution_time_ms").alias("average_total_execution_time_ms"),
        mean("time_to_first_row_ms").alias("average_time_to_first_row_ms"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_token_usage"),
        F.coalesce(rounded(F.avg(tokens), 2), F.lit(0.0)).alias("average_token_usage"),
    ]


def iteration_stats() -> list[Column]:
    n = F.coalesce(F.col("iterations"), F.lit(0)).cast("long")
    return [
        F.coalesce(rounded(F.avg(n), 2), F.lit(0.0)).alias("average_iterations"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_iterations"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_iterations"),
    ]


def iteration_distribution(cases: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the MAP from number of iterations to number of cases."""
    n = F.coalesce(F.col("iterations"), F.lit(0)).cast("int")
    per = cases.groupBy(run, n.alias("iterations")).agg(F.count("*").alias("n"))
    return per.groupBy(run).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("iterations", "n")))).alias(
            "iteration_distribution"
        )
    )


def evaluator_averages(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Average score (4 digits) and number of applicable results per run and evaluator."""
    return results.groupBy(run, "evaluator").agg(
        F.coalesce(rounded(F.avg(F.when(F.col("applicable"), F.col("score"))), 4), F.lit(0.0)).alias(
            "average"
        ),
        F.count_if("applicable").alias("evaluated"),
    )


def wide_averages(averages: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: each evaluator's average (0 when it judged nothing) and counts map."""
    columns = [
        F.coalesce(F.max(F.when(F.col("evaluator") == e, F.col("average"))), F.lit(0.0)).alias(e)
        for e in WEIGHTS
    ]
    counts = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("evaluator", "evaluated")))
    ).alias("evaluated_counts")
    return averages.groupBy(run).agg(*columns, counts)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights must sum to 1 within 0.001."""
    total = sum(weights.values())
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"composite weights must sum to 1.0, got {total:.4f}")
    return weights


def checked_weight_sum(weight: Column) -> Column:
    """The sum of a weight column, failing the job unless it is 1 within 0.001."""
    total = F.sum(weight)
    return F.when(F.abs(total - 1.0) <= 0.001, total).otherwise(
        F.raise_error(F.concat(F.lit("composite weights must sum to 1.0, got "), total)).cast("double")
    )


def composite_scores(averages: DataFrame, weights: dict[str, float] | None = None,
                     run: str = "run_id") -> DataFrame:
    """Weighted mean of the rounded averages of the evaluators that judged anything."""
    weights = check_weights(weights or WEIGHTS)

    def of(name: str, value: str) -> Column:
        return F.max(F.when((F.col("evaluator") == name) & (F.col("evaluated") > 0), F.col(value)))

    # One term per evaluator in a fixed order: sums of doubles depend on it.
    terms = averages.groupBy(run).agg(*[of(n, "average").alias(f"_{n}") for n in weights])
    total, score = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        judged = F.col(f"_{name}").isNotNull()
        total = total + F.when(judged, F.lit(float(w))).otherwise(0.0)
        score = score + F.coalesce(F.lit(float(w)) * F.col(f"_{name}"), F.lit(0.0))
    return terms.select(
        run, F.coalesce(rounded(score / F.when(total > 0, total), 4), F.lit(0.0)).alias("composite_score")
    )


# Columns the statistics read; a run's cases may lack those its source cannot know.
CASE_COLUMNS = T.StructType(
    [
        T.StructField("agent_answered", T.BooleanType()),
        T.StructField("agent_ok", T.BooleanType()),
        T.StructField("agent_crashed", T.BooleanType()),
        T.StructField("timed_out", T.BooleanType()),
        T.StructField("expected_ok", T.BooleanType()),
        T.StructField("generated_ok", T.BooleanType()),
        T.StructField("generated_exec_ms", T.DoubleType()),
        T.StructField("generated_sql", T.StringType()),
        T.StructField("agent_latency_ms", T.DoubleType()),
        T.StructField("total_latency_ms", T.DoubleType()),
        T.StructField("total_execution_time_ms", T.DoubleType()),
        T.StructField("time_to_first_row_ms", T.DoubleType()),
        T.StructField("token_usage", T.LongType()),
        T.StructField("iterations", T.IntegerType()),
    ]
)


def with_case_columns(cases: DataFrame) -> DataFrame:
    missing = [f for f in CASE_COLUMNS if f.name not in cases.columns]
    return cases.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def has_sql() -> Column:
    return F.coalesce(F.col("generated_sql"), F.lit("")) != ""


def run_statistics(cases: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run with everything its cases alone decide."""
    figures = cases.groupBy(run).agg(
        *case_counts(),
        *latency_bounds(F.col("total_latency_ms"), "latency"),
        *latency_bounds(F.col("agent_latency_ms"), "agent_latency", has_sql()),
        *failure_stats(),
        *performance_stats(),
        *iteration_stats(),
    )
    total = percentiles(cases, [run], F.col("total_latency_ms"), "latency")
    agent = percentiles(cases.filter(has_sql()), [run], F.col("agent_latency_ms"), "agent_latency")
    out = figures.join(total, run, "left").join(agent, run, "left")
    return out.fillna(
        0.0, [f"{side}_{p}" for side in ("latency", "agent_latency") for p in ("p50", "p95", "p99")]
    )

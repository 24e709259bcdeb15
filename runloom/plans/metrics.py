"""Queries over run facts: statistics, grades, reports and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.operators import reports as R
from runloom.plans.registry import query
from runloom.sources.adapters import RUNS_SQL, runs, table, text_runs, TEXT_RUNS_SQL

WITH_RUNS = f"WITH {RUNS_SQL}"


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


METRIC_FLOATS = (
    "success_rate",
    "avg_execution_time",
    "p50_execution_time",
    "p95_execution_time",
    "p99_execution_time",
    "total_cost",
    "avg_tokens_per_request",
)

METRICS_SQL = """
  count(*) AS total_executions,
  count(*) FILTER (status = 'success') AS successful_count,
  count(*) - count(*) FILTER (status = 'success') AS failed_count,
  round(count(*) FILTER (status = 'success') / CAST(count(*) AS DOUBLE), 6) AS success_rate,
  round(avg(execution_time), 6) AS avg_execution_time,
  round(quantile_cont(execution_time, 0.5), 6) AS p50_execution_time,
  round(quantile_cont(execution_time, 0.95), 6) AS p95_execution_time,
  round(quantile_cont(execution_time, 0.99), 6) AS p99_execution_time,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
  round(sum(cost), 6) AS total_cost,
  round(sum(tokens_used) / CAST(count(*) AS DOUBLE), 6) AS avg_tokens_per_request"""

EFFICIENCY_SQL = """
  CASE WHEN tokens_used = 0 THEN 0.0
       ELSE least((2 + length('text') + length(output_text) + 6) / (tokens_used * CAST(4 AS DOUBLE)), 1.0) END"""


def grade_sql(a="2.0, 0.8", b="5.0, 0.6", c="10.0, 0.4") -> str:
    (a1, a2), (b1, b2), (c1, c2) = (x.split(", ") for x in (a, b, c))
    return f"""
graded AS (
  SELECT *, {EFFICIENCY_SQL} AS efficiency,
         CASE WHEN execution_time < {a1} AND {EFFICIENCY_SQL} >= {a2} THEN 'excellent'
              WHEN execution_time < {b1} AND {EFFICIENCY_SQL} >= {b2} THEN 'good'
              WHEN execution_time < {c1} AND {EFFICIENCY_SQL} >= {c2} THEN 'fair'
              ELSE 'poor' END AS grade
  FROM runs
)"""


@query(
    "percentiles",
    f"""{WITH_RUNS} SELECT workflow_id,
  round(quantile_cont(execution_time, 0.5), 6) AS p50_execution_time,
  round(quantile_cont(execution_time, 0.95), 6) AS p95_execution_time,
  round(quantile_cont(execution_time, 0.99), 6) AS p99_execution_time
FROM runs GROUP BY workflow_id""",
)
def percentiles(spark, folder):
    return rounded(M.percentiles(runs(spark, folder), ["workflow_id"]), *M.PERCENTILES)


@query("stats_global", f"{WITH_RUNS} SELECT {METRICS_SQL} FROM runs")
def stats_global(spark, folder):
    return rounded(M.run_metrics(runs(spark, folder)), *METRIC_FLOATS)


@query("stats_by_workflow", f"{WITH_RUNS} SELECT workflow_id, {METRICS_SQL} FROM runs GROUP BY workflow_id")
def stats_by_workflow(spark, folder):
    return rounded(M.run_metrics(runs(spark, folder), ["workflow_id"]), *METRIC_FLOATS)


DIMENSIONS = (("workflow_id",), ("workflow_id", "prompt_variant"), ("dataset",), ())


@query(
    "stats_by_dimensions",
    f"""{WITH_RUNS}, fanned AS (
  SELECT 'workflow_id' AS dimension, workflow_id AS group_value, * FROM runs
  UNION ALL
  SELECT 'workflow_id+prompt_variant', workflow_id || '/' || coalesce(prompt_variant, '-'), * FROM runs
  UNION ALL SELECT 'dataset', coalesce(dataset, '-'), * FROM runs
  UNION ALL SELECT 'all', 'all', * FROM runs
) SELECT dimension, group_value, {METRICS_SQL} FROM fanned GROUP BY dimension, group_value""",
)
def stats_by_dimensions(spark, folder):
    return rounded(M.metrics_by_dimensions(runs(spark, folder), DIMENSIONS), *METRIC_FLOATS)


@query(
    "token_efficiency",
    f"{WITH_RUNS} SELECT execution_id, CAST(round(CAST(CAST({EFFICIENCY_SQL} AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS efficiency FROM runs",
)
def token_efficiency(spark, folder):
    efficiency = M.token_efficiency(F.col("outputs"), F.col("tokens_used"))
    return runs(spark, folder).select("execution_id", F.round(efficiency, 6).alias("efficiency"))


@query(
    "classify_runs",
    f"{WITH_RUNS}, {grade_sql()} SELECT execution_id, CAST(round(CAST(CAST(efficiency AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS efficiency, grade FROM graded",
)
def classify_runs(spark, folder):
    graded = M.classify_runs(runs(spark, folder))
    return graded.select("execution_id", F.round("efficiency", 6).alias("efficiency"), "grade")


@query(
    "classify_custom",
    f"{WITH_RUNS}, {grade_sql('1.0, 0.9', '4.0, 0.5', '20.0, 0.1')} SELECT execution_id, grade FROM graded",
)
def classify_custom(spark, folder):
    custom = {"excellent": (1.0, 0.9), "good": (4.0, 0.5), "fair": (20.0, 0.1)}
    return M.classify_runs(runs(spark, folder), custom).select("execution_id", "grade")


GRADES_SQL = "(VALUES ('excellent'), ('good'), ('fair'), ('poor')) g(grade)"


@query(
    "grade_distribution",
    f"""{WITH_RUNS}, {grade_sql()}, wf AS (SELECT workflow_id, count(*) AS total FROM runs GROUP BY 1)
SELECT wf.workflow_id, g.grade, count(r.execution_id) AS n,
       round(count(r.execution_id) * 100.0 / max(wf.total), 6) AS percent
FROM wf CROSS JOIN {GRADES_SQL}
LEFT JOIN graded r ON r.workflow_id = wf.workflow_id AND r.grade = g.grade
GROUP BY wf.workflow_id, g.grade""",
)
def grade_distribution(spark, folder):
    graded = M.classify_runs(runs(spark, folder))
    return rounded(M.grade_distribution(graded, ["workflow_id"]), "percent")


@query(
    "details_report",
    f"""{WITH_RUNS} SELECT workflow_id, execution_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, status,
  CAST(round(CAST(CAST(execution_time AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE) AS execution_time, tokens_used,
  CAST(round(CAST(CAST(cost AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS cost,
  CASE WHEN status = 'success' THEN '' ELSE status || ' in ' || event_type END AS error_message
FROM runs""",
)
def details_report(spark, folder):
    return R.details_report(runs(spark, folder))


@query(
    "performance_report",
    f"""{WITH_RUNS} SELECT workflow_id, count(*) AS executions,
  printf('%.2f%%', count(*) FILTER (status = 'success') * 100 / CAST(count(*) AS DOUBLE)) AS success_rate,
  CAST(round(CAST(CAST(avg(execution_time) AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE) AS avg_time,
  CAST(round(CAST(CAST(quantile_cont(execution_time, 0.95) AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE) AS p95_time,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens, CAST(round(CAST(CAST(sum(cost) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS total_cost
FROM runs GROUP BY workflow_id""",
)
def performance_report(spark, folder):
    return R.performance_report(runs(spark, folder))


@query(
    "overview_report",
    f"""{WITH_RUNS}, {grade_sql()}, s AS (SELECT {METRICS_SQL} FROM runs),
d AS (SELECT g.grade, count(r.execution_id) AS n, (SELECT count(*) FROM runs) AS total
      FROM {GRADES_SQL} LEFT JOIN graded r ON r.grade = g.grade GROUP BY g.grade)
SELECT 'total_executions' AS metric, CAST(total_executions AS VARCHAR) AS value FROM s
UNION ALL SELECT 'successful_count', CAST(successful_count AS VARCHAR) FROM s
UNION ALL SELECT 'failed_count', CAST(failed_count AS VARCHAR) FROM s
UNION ALL SELECT 'success_rate', printf('%.2f%%', success_rate * 100) FROM s
UNION ALL SELECT 'avg_execution_time', printf('%.3fs', CAST(round(CAST(CAST(avg_execution_time AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)) FROM s
UNION ALL SELECT 'p50_execution_time', printf('%.3fs', CAST(round(CAST(CAST(p50_execution_time AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)) FROM s
UNION ALL SELECT 'p95_execution_time', printf('%.3fs', CAST(round(CAST(CAST(p95_execution_time AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)) FROM s
UNION ALL SELECT 'p99_execution_time', printf('%.3fs', CAST(round(CAST(CAST(p99_execution_time AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)) FROM s
UNION ALL SELECT 'total_tokens', format('{{:,}}', total_tokens) FROM s
UNION ALL SELECT 'total_cost', printf('$%.2f', CAST(round(CAST(CAST(total_cost AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)) FROM s
UNION ALL SELECT 'avg_tokens_per_request', printf('%.1f', CAST(round(CAST(CAST(avg_tokens_per_request AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE)) FROM s
UNION ALL SELECT 'grade_' || grade, printf('%d (%.2f%%)', n, n * 100 / CAST(total AS DOUBLE)) FROM d""",
)
def overview_report(spark, folder):
    graded = M.classify_runs(runs(spark, folder))
    return R.overview_report(M.run_metrics(graded), M.grade_distribution(graded))


@query(
    "run_report",
    f"""{WITH_RUNS} SELECT count(*) AS total_runs, count(*) FILTER (status = 'success') AS success,
  round(count(*) FILTER (status = 'success') / CAST(count(*) AS DOUBLE), 6) AS success_rate,
  round(avg(CASE WHEN status = 'error' THEN 0.0 ELSE execution_time END), 6) AS average_duration_seconds
FROM runs""",
)
def run_report(spark, folder):
    # runs that broke off with an error carry no duration
    timed = runs(spark, folder).withColumn(
        "duration_seconds", F.when(F.col("status") != "error", F.col("execution_time"))
    )
    return rounded(R.run_report(timed), "success_rate", "average_duration_seconds")


@query(
    "runs_by_workflow",
    f"{WITH_RUNS} SELECT execution_id, status, tokens_used FROM runs WHERE workflow_id = 'wf_3'",
)
def runs_by_workflow(spark, folder):
    return runs(spark, folder).where(F.col("workflow_id") == "wf_3").select("execution_id", "status", "tokens_used")


@query(
    "runs_by_variant",
    f"""{WITH_RUNS} SELECT execution_id, status, tokens_used FROM runs
WHERE workflow_id = 'wf_3' AND prompt_variant = 'v1'""",
)
def runs_by_variant(spark, folder):
    chosen = (F.col("workflow_id") == "wf_3") & (F.col("prompt_variant") == "v1")
    return runs(spark, folder).where(chosen).select("execution_id", "status", "tokens_used")


@query(
    "runs_by_dataset",
    f"{WITH_RUNS} SELECT execution_id, status, tokens_used FROM runs WHERE dataset = 'ds_2'",
)
def runs_by_dataset(spark, folder):
    return runs(spark, folder).where(F.col("dataset") == "ds_2").select("execution_id", "status", "tokens_used")


@query("run_count", f"{WITH_RUNS} SELECT count(*) AS run_count FROM runs")
def run_count(spark, folder):
    return runs(spark, folder).agg(F.count(F.lit(1)).alias("run_count"))


@query(
    "failure_rate",
    f"""{WITH_RUNS}, wf AS (SELECT DISTINCT workflow_id FROM runs UNION SELECT 'nation_' || n_nationkey FROM nation)
SELECT wf.workflow_id,
       round(coalesce(avg(CASE WHEN r.status = 'success' THEN 0.0 WHEN r.status IS NOT NULL THEN 1.0 END), 1.0), 6)
         AS failure_rate
FROM wf LEFT JOIN runs r ON r.workflow_id = wf.workflow_id GROUP BY wf.workflow_id""",
)
def failure_rate(spark, folder):
    facts = runs(spark, folder)
    idle = table(spark, folder, "nation").select(
        F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("workflow_id")
    )
    workflows = facts.select("workflow_id").distinct().unionByName(idle)
    return rounded(M.failure_rate(workflows, facts), "failure_rate")


@query(
    "runs_failures",
    f"""{WITH_RUNS} SELECT workflow_id, count(*) AS total_runs,
  count(*) FILTER (NOT (tokens_used > 200 AND status IN ('success', 'timeout')) AND status <> 'success') AS failures
FROM runs GROUP BY workflow_id""",
)
def runs_failures(spark, folder):
    # the result text of a long run says success even when the run timed out
    spoken = (F.col("tokens_used") > 200) & F.col("status").isin("success", "timeout")
    results = runs(spark, folder).withColumn("result", F.when(spoken, "SUCCESS").when(F.col("status") == "error", "broken"))
    return M.runs_failures(results)


@query(
    "judge_pass_rate",
    """SELECT 'wf_' || d.source AS workflow_id, d.lang AS prompt_hash, count(*) AS evaluated,
  round(avg(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS score,
  count(*) FILTER (NOT (l.quality = 1 AND l.toxic = 0)) AS failed_runs
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2""",
)
def judge_pass_rate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    verdicts = (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            F.concat(F.lit("wf_"), "source").alias("workflow_id"),
            F.col("lang").alias("prompt_hash"),
            ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"),
        )
    )
    return rounded(M.judge_pass_rate(verdicts, ["workflow_id", "prompt_hash"]), "score")


@query(
    "failure_signature",
    f"""WITH {TEXT_RUNS_SQL} SELECT DISTINCT workflow_id,
  sha256(trim(regexp_replace(output_text, '\\s+', ' ', 'g'))) AS part
FROM samples WHERE status <> 'success'""",
)
def failure_signature(spark, folder):
    failures = text_runs(spark, folder).where(F.col("status") != "success")
    return M.failure_signature(failures, ["workflow_id"], "output_text")


DAYS_SQL = f"""{WITH_RUNS}, trials AS (
  SELECT workflow_id, CAST(ts AS DATE) AS day, count(*) FILTER (status = 'error') AS issues,
         count(*) FILTER (status = 'timeout') % 4 AS actions
  FROM runs GROUP BY 1, 2
)"""


def daily_trials(spark, folder):
    return (
        runs(spark, folder)
        .groupBy("workflow_id", F.to_date("ts").alias("day"))
        .agg(
            F.count_if(F.col("status") == "error").alias("issues"),
            (F.count_if(F.col("status") == "timeout") % 4).alias("actions"),
        )
    )


@query(
    "score_trial",
    f"""{DAYS_SQL} SELECT workflow_id, CAST(day AS VARCHAR) AS day,
  CAST(100 - 10 * issues - 2 * actions AS DOUBLE) AS score FROM trials""",
)
def score_trial(spark, folder):
    trials = daily_trials(spark, folder)
    score = M.score_trial(F.col("issues"), F.col("actions"))
    return trials.select("workflow_id", F.col("day").cast("string").alias("day"), score.alias("score"))


@query(
    "error_rate_step",
    f"""{DAYS_SQL} SELECT workflow_id, CAST(day AS VARCHAR) AS day,
  round(least(1.0, issues / CAST(greatest(actions * 5, 1) AS DOUBLE)), 6) AS error_rate FROM trials""",
)
def error_rate_step(spark, folder):
    rate = M.error_rate_step(F.col("issues"), F.col("actions") * 5)
    return daily_trials(spark, folder).select(
        "workflow_id", F.col("day").cast("string").alias("day"), F.round(rate, 6).alias("error_rate")
    )

"""Report tables: details, performance, overview and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.metrics import grade_distribution, run_metrics


def details_report(runs: DataFrame) -> DataFrame:
    """One line per run with rounded numbers and an empty string for no error."""
    return runs.select(
        "workflow_id",
        "execution_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "status",
        F.round("execution_time", 3).alias("execution_time"),
        "tokens_used",
        F.round("cost", 4).alias("cost"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def performance_report(runs: DataFrame) -> DataFrame:
    """Per workflow: runs, success share as text, mean and p95 time, tokens and cost."""
    stats = run_metrics(runs, ["workflow_id"])
    return stats.select(
        "workflow_id",
        F.col("total_executions").alias("executions"),
        F.format_string("%.2f%%", F.col("success_rate") * 100).alias("success_rate"),
        F.round("avg_execution_time", 3).alias("avg_time"),
        F.round("p95_execution_time", 3).alias("p95_time"),
        "total_tokens",
        F.round("total_cost", 4).alias("total_cost"),
    )


def overview_report(metrics: DataFrame, grades: DataFrame) -> DataFrame:
    """Key/value lines: eleven metrics and four grade lines, as formatted text."""
    def seconds(name: str):
        return F.format_string("%.3fs", F.col(name))

    lines = [
        ("total_executions", F.col("total_executions").cast("string")),
        ("successful_count", F.col("successful_count").cast("string")),
        ("failed_count", F.col("failed_count").cast("string")),
        ("success_rate", F.format_string("%.2f%%", F.col("success_rate") * 100)),
        ("avg_execution_time", seconds("avg_execution_time")),
        ("p50_execution_time", seconds("p50_execution_time")),
        ("p95_execution_time", seconds("p95_execution_time")),
        ("p99_execution_time", seconds("p99_execution_time")),
        ("total_tokens", F.format_number("total_tokens", 0)),
        ("total_cost", F.format_string("$%.2f", F.col("total_cost"))),
        ("avg_tokens_per_request", F.format_string("%.1f", F.col("avg_tokens_per_request"))),
    ]
    stats = metrics.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in lines]))
    )
    shares = grades.select(
        F.concat(F.lit("grade_"), F.col("grade")).alias("metric"),
        F.format_string("%d (%.2f%%)", F.col("n"), F.col("percent")).alias("value"),
    )
    return stats.unionByName(shares)


def run_report(results: DataFrame) -> DataFrame:
    """One row: totals, success share and mean duration where a missing duration counts as 0."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("status") == "success")
    return results.agg(
        total.alias("total_runs"),
        good.alias("success"),
        F.coalesce(F.try_divide(good, total), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.coalesce("duration_seconds", F.lit(0.0))), F.lit(0.0)).alias("average_duration_seconds"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` unchanged, but a job that reads it fails with ``message`` when it has no rows."""
    found = df.select(F.lit(1).alias("_x")).limit(1).agg(F.count(F.lit(1)).alias("_rows"))
    broken = [F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.unionByName(found.where(F.col("_rows") == 0).select(*broken))


def export_statistics(metrics: DataFrame, grades: DataFrame, folder: str) -> None:
    overview_report(metrics, grades).write.mode("overwrite").json(f"{folder}/overview")


def export_results(graded: DataFrame, folder: str, overview: bool = True) -> None:
    """Write the details, performance and overview tables; fails when there are no runs."""
    checked = require_rows(graded, "no results to export")
    details_report(checked).write.mode("overwrite").parquet(f"{folder}/details")
    performance_report(graded).write.mode("overwrite").parquet(f"{folder}/performance")
    if overview:
        export_statistics(run_metrics(graded), grade_distribution(graded), folder)

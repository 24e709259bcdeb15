"""Turning raw payloads and task records into run facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import payload as P
from runloom.operators.metrics import seconds_between
from runloom.operators.ordering import with_position

# The task states that end a task, and the run status each state becomes.
TERMINAL = ("succeeded", "failed", "timeout", "cancelled", "error")
RUN_STATUS = {"succeeded": "success", "failed": "failed", "timeout": "timeout"}
RETRYABLE = ("failed", "timeout", "error")


def with_payload(records: DataFrame, raw: str = "payload") -> DataFrame:
    """Parse the JSON text once per row; unreadable text becomes NULL."""
    return records.withColumn("_v", F.try_parse_json(raw))


def status_from_payload(v: Column) -> Column:
    return P.status(v, P.FINE_STATUS, trim=True)


def status_from_run(v: Column) -> Column:
    return P.status(v, P.COARSE_STATUS, trim=False)


def normalize_samples(records: DataFrame, keys: Sequence[str], order: Sequence[str], raw: str = "payload") -> DataFrame:
    """Samples: position per workflow, status, output text and duration of every payload."""
    parsed = with_payload(records, raw)
    v = F.col("_v")
    slim = parsed.select(
        *keys,
        *order,
        status_from_run(v).alias("status"),
        P.output_text(v, F.col(raw)).alias("output_text"),
        P.metric(v, "duration_seconds").alias("duration_seconds"),
    )
    return with_position(slim, keys, order)


def safe_dirname(name: Column) -> Column:
    """File-system safe folder name of a workflow id; ``app`` when nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(name, r"[/\\]", "_"), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.btrim(flat, F.lit("._-")), F.lit("")), F.lit("app"))


def input_key(key: Column) -> Column:
    return F.when(key == "FilelD", "FileID").otherwise(key)


def typed_inputs(rows: DataFrame, keys: Sequence[str], inputs: str) -> DataFrame:
    """One row per declared input of a JSON object: name, value, lower-case type and a duplicate flag.

    Values may be plain or ``{"type": .., "value": ..}``. Two keys that become equal after fixing the
    known misspelling are both flagged, so the caller can set the row aside.
    """
    as_map = F.from_json(inputs, "map<string,string>")
    names = F.transform(F.map_keys(as_map), input_key)
    exploded = rows.select(*keys, names.alias("_names"), F.explode(as_map).alias("_key", "_raw"))
    name = input_key(F.col("_key"))

    def unwrapped(wrapped: Column) -> Column:
        has_value = F.coalesce(F.schema_of_variant(wrapped).rlike(r"^OBJECT<(.*, )?value: "), F.lit(False))
        declared = F.struct(P.at(wrapped, "$.value").alias("value"), F.lower(P.at(wrapped, "$.type")).alias("declared_type"))
        plain = F.struct(F.col("_raw").alias("value"), F.lit(None).cast("string").alias("declared_type"))
        return F.when(has_value, declared).otherwise(plain)

    return exploded.select(
        *keys,
        name.alias("name"),
        (F.size(F.filter("_names", lambda n: n == name)) > 1).alias("duplicate"),
        F.inline(F.transform(F.array(F.try_parse_json("_raw")), unwrapped)),
    )


def render_runtime_tokens(inputs: Column, index: Column, as_of: Column) -> Column:
    """Replace ``{ID}`` by the row position and ``{TIME}`` by ``as_of`` in every input value."""
    stamp = F.date_format(as_of, "yyyyMMddHHmmss")
    return F.transform_values(
        inputs,
        lambda _, v: F.replace(F.replace(v, F.lit("{ID}"), index.cast("string")), F.lit("{TIME}"), stamp),
    )


def run_status_of_task(state: Column) -> Column:
    """Cancelled and unfinished tasks count as errors."""
    out = None
    for task, run in RUN_STATUS.items():
        out = F.when(state == task, run) if out is None else out.when(state == task, run)
    return out.otherwise("error")


def task_result_projection(tasks: DataFrame) -> DataFrame:
    """Results of finished tasks: seconds from start to finish and the task's own error before the metadata's."""
    took = seconds_between(F.col("started_at"), F.col("finished_at"))
    return tasks.where(F.col("task_status").isin(*TERMINAL)).select(
        "task_id",
        "workflow_id",
        "dataset",
        "scenario",
        "task_status",
        "attempt_count",
        "created_at",
        "finished_at",
        F.coalesce(took, F.lit(0.0)).alias("execution_time"),
        F.coalesce(F.nullif("error_message", F.lit("")), F.try_element_at("metadata", F.lit("error_message"))).alias("error_message"),
        "tokens_used",
        "cost",
        "metadata",
    )


def task_to_run(results: DataFrame) -> DataFrame:
    """Run facts of task results; missing tokens and cost become 0."""
    return results.select(
        "workflow_id",
        F.col("task_id").alias("execution_id"),
        F.col("created_at").alias("ts"),
        run_status_of_task(F.col("task_status")).alias("status"),
        "execution_time",
        F.coalesce("tokens_used", F.lit(0).cast("long")).alias("tokens_used"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        "error_message",
        F.try_element_at("metadata", F.lit("prompt_variant")).alias("prompt_variant"),
        "dataset",
        F.create_map(
            F.lit("dataset"), "dataset", F.lit("scenario"), "scenario",
            F.lit("attempt_count"), F.col("attempt_count").cast("string"),
        ).alias("metadata"),
    )


def can_retry(state: Column, attempt_count: Column, max_retries: Column) -> Column:
    return state.isin(*RETRYABLE) & (attempt_count <= max_retries)


def discover_workflows(catalog: DataFrame, workflow_id: str | None = None, tag: str | None = None) -> DataFrame:
    """By id, else by tag, else all."""
    if workflow_id:
        return catalog.where(F.col("id") == workflow_id)
    if tag:
        return catalog.where(F.array_contains("tags", tag))
    return catalog


def enabled_workflows(plan: DataFrame) -> DataFrame:
    return plan.where(F.coalesce("enabled", F.lit(True)))


def union_runs(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All run tables in one, by column name; columns a table lacks are NULL."""
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

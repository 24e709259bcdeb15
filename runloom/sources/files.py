"""Reading and writing run records, references and workflow definitions as files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runloom.functions import payload as P
from runloom.functions.text import is_json_object, let, strip
from runloom.operators.issues import MAX_FAILURE_RATE, SIMILARITY_THRESHOLD
from runloom.operators.metrics import runs_failures
from runloom.operators.normalize import safe_dirname

RECORD_SCHEMA = "workflow_id string, index long, inputs string, result string, meta string"
# File names tried for references and exported definitions, best first.
REFERENCE_NAMES = ("{safe}.yaml", "{safe}.yml", "{safe}.json", "{id}.yaml", "{id}.yml", "{id}.json")
DSL_NAMES = (
    "app_{safe}.yaml", "app_{safe}.yml", "app_{safe}_export.yaml", "app_{safe}_export.yml", "app_export.yaml", "app_export.yml",
    "app_{id}.yaml", "app_{id}.yml", "app_{id}_export.yaml", "app_{id}_export.yml",
)
DSL_FOLDERS = ("{safe}/", "{id}/")


def plain_path(path: Column) -> Column:
    """Path without scheme, as listings and tables may name the same file differently."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:(//)?(?=/)", "")


# Run records -------------------------------------------------------------------------------------


def write_run_records(records: DataFrame, folder: str) -> None:
    """Write records ``workflow_id, index, inputs, result, meta`` as JSON lines, one folder per workflow.

    The folder name is the sanitized id; the id itself stays in the record. Rows are spread by workflow
    and position, so a hot workflow becomes several files rather than one task.
    """
    parts = records.withColumn("workflow_dir", safe_dirname(F.col("workflow_id")))
    split = parts.repartition("workflow_dir", F.floor(F.col("index") / 100_000))
    split.write.mode("overwrite").partitionBy("workflow_dir").json(folder)


#: Why a record is rejected.
EMPTY, NOT_JSON, NOT_OBJECT = "empty", "not JSON", "not a JSON object"


def _labelled(v: Column, raw: Column, path: Column) -> Column:
    """Struct of a record's fields, or of the reason why it is none."""
    inner = F.try_variant_get(v, "$.result", "variant")
    has_result = F.try_variant_get(v, "$.result", "string").isNotNull()
    number = F.regexp_extract(path, r"run_(\d+)\.json$", 1)
    reason = F.when(strip(raw) == "", EMPTY).when(v.isNull(), NOT_JSON).when(~is_json_object(v), NOT_OBJECT)
    fine = reason.isNull()
    return F.struct(
        F.when(fine, F.coalesce(P.at(v, "$.workflow_id"), F.regexp_extract(path, r"([^/]+)/runs/[^/]+$", 1))).alias("workflow_id"),
        F.when(fine, F.coalesce(F.try_variant_get(v, "$.index", "long"), F.nullif(number, F.lit("")).try_cast("long"))).alias("index"),
        F.when(fine, F.when(has_result, F.to_json(inner)).otherwise(raw)).alias("payload"),
        reason.alias("reason"),
        path.alias("path"),
        F.when(~fine, raw).alias("text"),
    )


def labelled_run_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Every record that is there: ``workflow_id, index, payload`` of the readable ones, ``reason, path, text`` of the others.

    ``payload`` is the JSON text of the record's ``result``, else the whole record. With ``one_per_file``
    every file ``<id>/runs/run_<n>.json`` is one record; otherwise the files hold JSON lines. Order by
    ``index``: file names sort run 10 before run 2.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=one_per_file)
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"))
    return placed.select(F.inline(let(F.try_parse_json("value"), lambda v: F.array(_labelled(v, F.col("value"), F.col("_path"))))))


def read_run_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Run payloads ``workflow_id, index, payload`` of the readable records; see :func:`labelled_run_records`."""
    return labelled_run_records(spark, path, one_per_file).where(F.col("reason").isNull()).select("workflow_id", "index", "payload")


def sort_run_records(spark: SparkSession, path: str, target: str, one_per_file: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``(records, rejected, counts)``: read once, written below ``target`` and read back from there.

    ``rejected`` has ``reason, path, text``. ``counts`` says how many records there were, how many of them are valid, and how many
    fell to each reason; the counts are observed while the records are written, so nothing is read twice.
    """
    seen = Observation("run records")
    label = F.col("reason")
    labelled = labelled_run_records(spark, path, one_per_file).observe(
        seen, F.count(F.lit(1)).alias("records"), F.count_if(label.isNull()).alias("valid"), *(F.count_if(label == r).alias(r) for r in (EMPTY, NOT_JSON, NOT_OBJECT))
    )
    labelled.withColumn("rejected", label.isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(target)
    every = spark.read.schema(labelled.schema.add("rejected", "boolean")).parquet(target)
    records = every.where(~F.col("rejected")).select("workflow_id", "index", "payload")
    return records, every.where("rejected").select("reason", "path", "text"), dict(seen.get)


def write_runs_summary(results: DataFrame, folder: str) -> None:
    """Totals and failures per workflow, and the list of files as rows of its own."""
    runs_failures(results).write.mode("overwrite").json(f"{folder}/summary")
    results.select("workflow_id", "path").distinct().write.mode("overwrite").json(f"{folder}/files")


# References --------------------------------------------------------------------------------------

SPEC_FIELDS = {
    "expected_outputs": "array<string>", "constraints": "array<string>", "similarity_threshold": "double", "max_failure_rate": "double",
    "max_latency_seconds": "double",
}
_SPEC_FIELDS = ", ".join(f"{name} {kind}" for name, kind in SPEC_FIELDS.items())


def _yaml_as_json(texts: pd.Series) -> pd.Series:
    """JSON of YAML texts, NULL for those that are none."""
    import yaml

    def converted(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text), ensure_ascii=False, default=str)
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    return texts.map(converted, na_action="ignore")


def document_tree(value: Column) -> Column:
    """VARIANT of a JSON object or YAML mapping, NULL for any other text; JSON does not leave the JVM."""
    own = F.try_parse_json(value)
    other = F.pandas_udf(_yaml_as_json, "string")(F.when(~is_json_object(own), value))
    return let(F.coalesce(F.when(is_json_object(own), own), F.try_parse_json(other)), lambda v: F.when(is_json_object(v), v))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``path, value``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")


def labelled_references(documents: DataFrame) -> DataFrame:
    """References of ``path, value``, with ``reason`` where a document is no mapping or a field has another type.

    Such a document, or field, counts as left out: it takes its default.
    """
    parsed = documents.withColumn("_tree", document_tree(F.col("value"))).withColumn("_spec", F.from_json(F.to_json("_tree"), _SPEC_FIELDS))
    given = {name: F.try_variant_get("_tree", f"$.{name}", "variant") for name in SPEC_FIELDS}
    wrong = [
        F.when(F.col(f"_spec.{name}").isNull() & value.isNotNull() & ~F.is_variant_null(value), f"{name} is no {'list' if kind.startswith('array') else 'number'}")
        for (name, kind), value in zip(SPEC_FIELDS.items(), given.values())
    ]
    reason = F.when(F.col("_tree").isNull(), F.when(strip(F.col("value")) == "", EMPTY).otherwise("no mapping")).otherwise(F.coalesce(*wrong))
    none = F.array().cast("array<string>")
    defaults = {"expected_outputs": none, "constraints": none, "similarity_threshold": F.lit(SIMILARITY_THRESHOLD), "max_failure_rate": F.lit(MAX_FAILURE_RATE)}
    fields = [F.coalesce(F.col(f"_spec.{n}"), defaults[n]).alias(n) if n in defaults else F.col(f"_spec.{n}").alias(n) for n in SPEC_FIELDS]
    return parsed.select("path", *fields, reason.alias("reason"))


def read_reference_spec(spark: SparkSession, path: str) -> DataFrame:
    """References of YAML or JSON files, missing fields at their defaults; :func:`labelled_references` says what was wrong."""
    return labelled_references(read_documents(spark, path)).drop("reason")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(plain_path(F.col("path")).alias("path"))


def _candidates(workflows: DataFrame, folder: str, names: list[str]) -> DataFrame:
    safe = safe_dirname(F.col("workflow_id"))
    filled = [
        F.replace(F.replace(F.lit(n), F.lit("{safe}"), safe), F.lit("{id}"), F.col("workflow_id")) for n in names
    ]
    base = folder.rstrip("/") + "/"
    return workflows.select(
        "workflow_id", F.posexplode(F.transform(F.array(*filled), lambda n: F.concat(F.lit(base), n))).alias("rank", "path")
    )


def _first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    return candidates.join(files.select("path").distinct(), "path").groupBy("workflow_id").agg(F.min_by("path", "rank").alias("path"))


def resolve_reference_file(workflows: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Reference file per workflow: its own ``reference_path``, else the best existing name in ``folder``.

    Only existing files count; workflows without one do not appear.
    """
    named = workflows.where(F.length("reference_path") > 0)
    own = named.select("workflow_id", F.lit(0).alias("rank"), F.col("reference_path").alias("path"))
    others = workflows.where(~F.coalesce(F.length("reference_path") > 0, F.lit(False)))
    return _first_existing(own.unionByName(_candidates(others, folder, list(REFERENCE_NAMES))), files)


def read_reference_texts(references: DataFrame, texts: DataFrame) -> DataFrame:
    """Reference text of each run by ``path``; NULL when the file is missing."""
    known = texts.select("path", F.col("value").alias("reference_text"))
    return references.join(known, "path", "left").drop("path")


# Workflow definitions ----------------------------------------------------------------------------


def parse_definitions(documents: DataFrame) -> DataFrame:
    """Parse YAML or JSON definitions ``workflow_id, path, value`` into VARIANT ``tree``; what is no mapping is an empty one."""
    return documents.select("workflow_id", "path", F.coalesce(document_tree(F.col("value")), F.parse_json(F.lit("{}"))).alias("tree"))


def read_workflow_dsl(spark: SparkSession, workflows: DataFrame, folder: str) -> DataFrame:
    """Exported definition per workflow as VARIANT ``tree``: the first existing candidate file."""
    names = [d + n for d in DSL_FOLDERS for n in DSL_NAMES]
    chosen = _first_existing(_candidates(workflows, folder, names), listing(spark, folder))
    return parse_definitions(read_documents(spark, folder).join(chosen, "path"))


# Step tables -------------------------------------------------------------------------------------


def append_timeline(timeline: DataFrame, folder: str) -> None:
    timeline.write.mode("append").parquet(folder)


def save_states(states: DataFrame, folder: str) -> None:
    """Append the states of one step; ``rounds.latest_state`` finds the newest per key."""
    states.write.mode("append").parquet(folder)

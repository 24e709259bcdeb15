"""Queries that write derived tables as files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.operators import reports as R
from runloom.plans.normalize import DURATION_SQL, EV
from runloom.plans import metrics as _metrics  # noqa: F401  its SQL describes what is exported
from runloom.plans.registry import SQL, query
from runloom.sources import adapters as A
from runloom.sources import files as FS
from runloom.sources import store as ST
from runloom.sources.adapters import RUNS_SQL, SPECS_SQL
from runloom.session import shared_folder


def fresh(spark, name):
    """A new folder below the shared one, so that no run meets files of another."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark, folder):
    """Run records whose result is the payload, kept as JSON text inside the record."""
    paid = A.payloads(spark, folder)
    return paid.select(
        "workflow_id", F.col("event_id").alias("index"), F.lit("{}").alias("inputs"), F.col("payload").alias("result"), F.lit("{}").alias("meta")
    )


@query(
    "read_run_records",
    f"""{EV} SELECT workflow_id, event_id AS "index", {DURATION_SQL} AS duration_seconds FROM ev""",
)
def read_run_records(spark, folder):
    from runloom.functions import payload as P

    out = fresh(spark, "records")
    FS.write_run_records(records(spark, folder), out)
    back = FS.read_run_records(spark, out)
    # the result is JSON text inside a JSON record, so it is unquoted before it is parsed
    inner = F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$", "string"), F.col("payload"))
    parsed = back.select("workflow_id", "index", F.try_parse_json(inner).alias("v"))
    return parsed.select("workflow_id", "index", P.metric(F.col("v"), "duration_seconds").alias("duration_seconds"))


@query(
    "read_run_rejects",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'not JSON' WHEN event_id % 11 = 4 THEN 'not a JSON object' WHEN event_id % 13 = 5 THEN 'empty' END AS reason,
  CASE WHEN event_id % 7 = 3 THEN '{"broken ' || event_id WHEN event_id % 11 = 4 THEN '[' || event_id || ']' WHEN event_id % 13 = 5 THEN '' END AS text FROM events)
SELECT reason, text, count(*) AS records, (SELECT count(*) FROM events) AS read, (SELECT count(*) FROM e WHERE reason IS NULL) AS valid FROM e WHERE reason IS NOT NULL GROUP BY 1, 2""",
)
def read_run_rejects(spark, folder):
    """The rejected among lines of run records, with the counts observed while all were read."""
    key = F.col("event_id")
    good = F.to_json(F.struct(F.lit("w").alias("workflow_id"), key.alias("index")))
    text = (
        F.when(key % 7 == 3, F.concat(F.lit('{"broken '), key.cast("string"))).when(key % 11 == 4, F.concat(F.lit("["), key.cast("string"), F.lit("]"))).when(key % 13 == 5, "").otherwise(good)
    )
    out = fresh(spark, "rejects")
    A.table(spark, folder, "events").select(text.alias("value")).write.text(f"{out}/lines")
    _, rejected, counts = FS.sort_run_records(spark, f"{out}/lines", f"{out}/sorted")
    grouped = rejected.groupBy("reason", "text").agg(F.count(F.lit(1)).alias("records"))
    return grouped.withColumns({"read": F.lit(counts["records"]).cast("long"), "valid": F.lit(counts["valid"]).cast("long")})


@query("write_run_records", """SELECT 'wf_' || (user_id % 10) AS workflow_id, count(*) AS records FROM events GROUP BY 1""")
def write_run_records(spark, folder):
    out = fresh(spark, "records")
    FS.write_run_records(records(spark, folder), out)
    return FS.read_run_records(spark, out).groupBy("workflow_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "write_runs_summary",
    f"""WITH {RUNS_SQL} SELECT workflow_id, count(*) AS total_runs, count(*) FILTER (status <> 'success') AS failures,
  count(DISTINCT event_id // 100) AS files FROM runs GROUP BY 1""",
)
def write_runs_summary(spark, folder):
    out = fresh(spark, "summary")
    results = A.runs(spark, folder).select(
        "workflow_id", "status", F.lit(None).cast("string").alias("result"),
        F.concat(F.lit("part_"), F.floor(F.col("seq") / 100).cast("string")).alias("path"),
    )
    FS.write_runs_summary(results, out)
    totals = spark.read.schema("workflow_id string, total_runs long, failures long").json(f"{out}/summary")
    files = spark.read.schema("workflow_id string, path string").json(f"{out}/files")
    return totals.join(files.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("files")), "workflow_id")


def spec_files(spark, folder, out):
    """One YAML reference file per workflow; some leave out fields that have defaults."""
    specs = A.reference_specs(spark, folder)
    number = F.regexp_extract("workflow_id", r"(\d+)$", 1).cast("int")
    text = F.concat(
        F.lit("expected_outputs:\n  - "), F.to_json(F.struct(F.element_at("expected_outputs", 1).alias("t"))),
        F.lit("\nconstraints: [Return JSON, "), F.element_at("constraints", 3), F.lit("]"),
        F.when(number % 2 == 0, F.lit("\nsimilarity_threshold: 0.5")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\nmax_latency_seconds: "), F.col("max_latency_seconds").cast("string")), F.lit("")),
    )
    files = specs.select("workflow_id", text.alias("value"))
    files.repartition("workflow_id").write.partitionBy("workflow_id").text(out)


@query(
    "read_reference_spec",
    f"""WITH {SPECS_SQL} SELECT workflow_id, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.72 END AS similarity_threshold,
  0.2 AS max_failure_rate, max_latency_seconds, 'Return JSON,zq' || item_id AS constraints, 1 AS expected FROM specs""",
)
def read_reference_spec(spark, folder):
    out = fresh(spark, "specs")
    spec_files(spark, folder, out)
    specs = FS.read_reference_spec(spark, out)
    return specs.select(
        F.regexp_extract("path", "workflow_id=([^/]+)", 1).alias("workflow_id"), "similarity_threshold", "max_failure_rate",
        "max_latency_seconds", F.array_join("constraints", ",").alias("constraints"), F.size("expected_outputs").alias("expected"),
    )


@query(
    "resolve_reference_file",
    """SELECT 'supplier ' || s_suppkey AS workflow_id, CASE s_suppkey % 4 WHEN 0 THEN '/own/' || s_suppkey || '.yaml'
  WHEN 1 THEN '/refs/supplier_' || s_suppkey || '.yml' ELSE '/refs/supplier ' || s_suppkey || '.json' END AS path
FROM supplier WHERE s_suppkey % 4 <> 3""",
)
def resolve_reference_file(spark, folder):
    key = F.col("s_suppkey")
    number = key.cast("string")
    suppliers = A.table(spark, folder, "supplier")
    workflows = suppliers.select(
        F.concat(F.lit("supplier "), number).alias("workflow_id"),
        F.when(key % 4 == 0, F.concat(F.lit("/own/"), number, F.lit(".yaml"))).alias("reference_path"),
    )
    existing = F.array_compact(
        F.array(
            F.when(key % 4 == 0, F.concat(F.lit("/own/"), number, F.lit(".yaml"))),
            F.when(key % 4 < 2, F.concat(F.lit("/refs/supplier_"), number, F.lit(".yml"))),
            F.when(key % 4 < 3, F.concat(F.lit("/refs/supplier "), number, F.lit(".json"))),
        )
    )
    files = suppliers.select(F.explode(existing).alias("path"))
    return FS.resolve_reference_file(workflows, files, "/refs")


@query(
    "read_reference_texts",
    """SELECT item_id, text || chr(10) AS reference_text FROM benchmark UNION ALL SELECT item_id + 1000000, NULL FROM benchmark""",
)
def read_reference_texts(spark, folder):
    out = fresh(spark, "texts")
    items = A.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(out)
    texts = FS.read_documents(spark, out)
    number = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    references = texts.select(number.alias("item_id"), "path").unionByName(
        texts.select((number + 1_000_000).alias("item_id"), F.concat("path", F.lit(".gone")).alias("path"))
    )
    return FS.read_reference_texts(references, texts)


@query(
    "read_workflow_dsl",
    """SELECT 'wf_' || item_id AS workflow_id, CASE WHEN item_id % 3 = 1 THEN '/workflow/graph' ELSE '/graph' END AS pointer, 4 AS nodes, text FROM benchmark""",
)
def read_workflow_dsl(spark, folder):
    from runloom.operators.dsl import extract_graph

    out = fresh(spark, "dsl")
    items = A.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("bench").alias("source"), "text"
    )
    named = A.trees_of(items).select(F.concat(F.lit("wf_"), F.col("doc_id").cast("string")).alias("workflow_id"), F.to_json("tree").alias("value"))
    # one file per definition; Spark names the files, so the workflow comes from the folder
    named.repartition("workflow_id").write.partitionBy("workflow_id").text(out)
    docs = FS.read_documents(spark, out).withColumn("workflow_id", F.regexp_extract("path", "workflow_id=([^/]+)", 1))
    graphs = FS.parse_definitions(docs).select("workflow_id", extract_graph(F.col("tree")).alias("g"))
    nodes = F.try_variant_get(F.col("g.graph"), "$.nodes", "array<variant>")
    text = F.try_variant_get(F.col("g.graph"), "$.nodes[0].data.prompt_template.messages[1].text", "string")
    return graphs.select("workflow_id", "g.pointer", F.size(nodes).alias("nodes"), text.alias("text"))


def exported(spark, folder):
    out = fresh(spark, "export")
    R.export_results(M.classify_runs(A.runs(spark, folder)), out)
    return out


@query("export_details", SQL["details_report"])
def export_details(spark, folder):
    """The details sheet as it is read back."""
    return spark.read.parquet(f"{exported(spark, folder)}/details")


@query("export_performance", SQL["performance_report"])
def export_performance(spark, folder):
    """The performance sheet as it is read back."""
    return spark.read.parquet(f"{exported(spark, folder)}/performance")


@query("export_overview", SQL["overview_report"])
def export_overview(spark, folder):
    """All lines of the overview as they are read back."""
    return spark.read.schema("metric string, value string").json(f"{exported(spark, folder)}/overview")


@query(
    "record_store",
    f"""{EV} SELECT workflow_id, event_id AS "index", props AS payload FROM ev WHERE workflow_id = 'wf_3' UNION ALL SELECT 'all', count(*), NULL FROM ev""",
)
def record_store(spark, folder):
    """The records of one workflow from an indexed store, and how many the store holds."""
    out = fresh(spark, "store")
    paid = A.table(spark, folder, "events").select(
        F.concat(F.lit("wf_"), (F.col("user_id") % 10).cast("string")).alias("workflow_id"), F.col("event_id").alias("index"), F.col("props").alias("payload")
    )
    ST.write_store(paid, out, "workflow_id", ["index"], rows_per_file=1000)
    total = ST.store_index(spark, out).agg(F.lit("all").alias("workflow_id"), F.sum("rows").alias("index"), F.lit(None).cast("string").alias("payload"))
    return ST.read_key(spark, out, "workflow_id", "wf_3").unionByName(total)


@query("reference_text_store", "SELECT item_id, text AS reference_text FROM benchmark UNION ALL SELECT item_id + 1000000, NULL FROM benchmark")
def reference_text_store(spark, folder):
    """Reference texts of many workflows in few files, joined by their path."""
    out = fresh(spark, "texts")
    path = F.concat(F.lit("refs/"), F.col("item_id").cast("string"), F.lit(".txt"))
    items = A.table(spark, folder, "benchmark").select("item_id", "text", path.alias("path"))
    ST.write_store(items.select("path", F.col("text").alias("value")), out, "path", rows_per_file=50)
    references = items.select("item_id", "path").unionByName(items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.concat("path", F.lit(".gone")).alias("path")))
    return FS.read_reference_texts(references, ST.read_store(spark, out))


@query("export_results", "SELECT 'details' AS sheet, count(*) AS n FROM events UNION ALL SELECT 'performance', count(DISTINCT user_id % 10) FROM events UNION ALL SELECT 'overview', 15")
def export_results(spark, folder):
    out = fresh(spark, "export")
    R.export_results(M.classify_runs(A.runs(spark, folder)), out)
    details, performance = spark.read.parquet(f"{out}/details"), spark.read.parquet(f"{out}/performance")
    overview = spark.read.schema("metric string, value string").json(f"{out}/overview")
    sheets = [("details", details), ("performance", performance), ("overview", overview)]
    counted = [df.agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n")).select("sheet", "n") for name, df in sheets]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("export_statistics", f"WITH {RUNS_SQL} SELECT 'total_executions' AS metric, CAST(count(*) AS VARCHAR) AS value FROM runs")
def export_statistics(spark, folder):
    out = fresh(spark, "statistics")
    graded = M.classify_runs(A.runs(spark, folder))
    R.export_statistics(M.run_metrics(graded), M.grade_distribution(graded), out)
    lines = spark.read.schema("metric string, value string").json(f"{out}/overview")
    return lines.where(F.col("metric") == "total_executions")

"""Queries over payloads, task records and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import payload as P
from runloom.operators import metrics as M
from runloom.operators import normalize as N
from runloom.operators import validate as V
from runloom.operators.ordering import with_position
from runloom.plans.registry import query
from runloom.sources.adapters import RUNS_SQL, TASKS_SQL, payloads, runs, table, tasks

EV = """WITH ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, 'wf_' || (user_id % 10) AS workflow_id,
         'out ' || event_id AS txt
  FROM events
)"""
STATUS_FINE = """CASE WHEN event_type IN ('click', 'view') THEN 'success'
  WHEN event_type = 'purchase' THEN 'partial_success'
  WHEN event_type = 'signup' AND k % 2 = 0 THEN 'success' WHEN event_type = 'signup' THEN 'weird'
  WHEN k < 30 THEN 'timeout' WHEN k < 60 THEN 'canceled' ELSE 'unknown' END"""
STATUS_COARSE = """CASE WHEN event_type = 'click' THEN ' completed ' WHEN event_type = 'view' THEN 'success'
  WHEN event_type = 'purchase' THEN 'partial'
  WHEN event_type = 'signup' AND k % 2 = 0 THEN 'success' WHEN event_type = 'signup' THEN 'weird'
  WHEN k < 30 THEN 'failed' WHEN k < 60 THEN 'cancelled' ELSE 'unknown' END"""
OUTPUT_SQL = """CASE WHEN event_type IN ('click', 'view') THEN txt
  WHEN event_type = 'purchase' THEN '{"inputs":{"q":"p"},"metrics":{"duration_seconds":' || k || '},"state":"partial"}'
  WHEN event_type = 'signup' AND k % 2 = 0 THEN txt WHEN event_type = 'signup' THEN '{"input":"a","state":"Weird"}'
  WHEN k < 30 THEN 'boom' WHEN k < 60 THEN '{"request":"r"}' WHEN k < 80 THEN '{"note":"n"}' ELSE 'not json' END"""
INPUT_SQL = """CASE WHEN event_type = 'view' THEN '{"q":"u' || user_id || '"}'
  WHEN event_type = 'purchase' THEN '{"q":"p"}'
  WHEN event_type = 'click' THEN '{"status":" Completed ","output":"' || txt || '","metrics":{"duration_seconds":' || k || '}}'
  WHEN event_type = 'signup' AND k % 2 = 0 THEN '{"output":"' || txt || '"}' WHEN event_type = 'signup' THEN 'a'
  WHEN k < 30 THEN '{"state":"Timed_Out","result":{"status":"FAILED","text":"boom"}}'
  WHEN k < 60 THEN 'r' WHEN k < 80 THEN '{"note":"n"}' ELSE 'not json' END"""
DURATION_SQL = "CASE WHEN event_type IN ('click', 'purchase') THEN CAST(k AS DOUBLE) END"


def parsed(spark, folder):
    return N.with_payload(payloads(spark, folder))


@query(
    "normalize_status",
    """WITH w AS (SELECT *, lower(trim(o_orderpriority)) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p LIKE '1%' THEN 'success' WHEN p LIKE '2%' THEN 'partial_success'
  WHEN p LIKE '3%' THEN 'timeout' WHEN p LIKE '4%' THEN 'canceled'
  WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'error' ELSE p END AS status FROM w""",
)
def normalize_status(spark, folder):
    level = F.substring("o_orderpriority", 1, 1)
    word = (
        F.when(level == "1", F.concat(F.lit(" "), F.lit("OK ")))
        .when(level == "2", "Partial-Success")
        .when(level == "3", "TIME_OUT\t")
        .when(level == "4", "Aborted")
        .when(F.col("o_orderstatus") == "F", "Failure")
        .when(F.col("o_orderstatus") == "O", "EXCEPTION")
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, folder, "orders").select("o_orderkey", P.normalize_status(word).alias("status"))


@query("status_from_payload", f"{EV} SELECT event_id, {STATUS_FINE} AS status FROM ev")
def status_from_payload(spark, folder):
    return parsed(spark, folder).select("event_id", N.status_from_payload(F.col("_v")).alias("status"))


@query("status_from_run", f"{EV} SELECT event_id, {STATUS_COARSE} AS status FROM ev")
def status_from_run(spark, folder):
    return parsed(spark, folder).select("event_id", N.status_from_run(F.col("_v")).alias("status"))


@query("extract_output_text", f"{EV} SELECT event_id, {OUTPUT_SQL} AS output_text FROM ev")
def extract_output_text(spark, folder):
    return parsed(spark, folder).select("event_id", P.output_text(F.col("_v"), F.col("payload")).alias("output_text"))


@query("extract_workflow_input", f"{EV} SELECT event_id, {INPUT_SQL} AS workflow_input FROM ev")
def extract_workflow_input(spark, folder):
    return parsed(spark, folder).select(
        "event_id", P.workflow_input(F.col("_v"), F.col("payload")).alias("workflow_input")
    )


@query("extract_metrics", f"{EV} SELECT event_id, {DURATION_SQL} AS duration_seconds FROM ev")
def extract_metrics(spark, folder):
    return parsed(spark, folder).select("event_id", P.metric(F.col("_v"), "duration_seconds").alias("duration_seconds"))


@query(
    "normalize_samples",
    f"""{EV} SELECT workflow_id, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, event_id) AS "index",
  {STATUS_COARSE} AS status, {OUTPUT_SQL} AS output_text, {DURATION_SQL} AS duration_seconds FROM ev""",
)
def normalize_samples(spark, folder):
    samples = N.normalize_samples(payloads(spark, folder), ["workflow_id"], ["ts", "event_id"])
    return samples.select("workflow_id", "index", "status", "output_text", "duration_seconds")


@query(
    "safe_dirname",
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[/\\]', '_', 'g'),
  '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'app') AS dirname FROM pages""",
)
def safe_dirname(spark, folder):
    return table(spark, folder, "pages").select("page_id", N.safe_dirname(F.col("url")).alias("dirname"))


@query(
    "typed_inputs",
    """SELECT o_orderkey, 'FileID' AS name, 'f' || o_custkey AS value, 'file' AS declared_type, o_custkey % 3 = 0 AS duplicate
FROM orders
UNION ALL SELECT o_orderkey, 'FileID', 'again', NULL, true FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'status', o_orderstatus, NULL, false FROM orders
UNION ALL SELECT o_orderkey, 'n', CAST(o_custkey AS VARCHAR), NULL, false FROM orders
UNION ALL SELECT o_orderkey, 'free', '{"type":"x"}', NULL, false FROM orders""",
)
def typed_inputs(spark, folder):
    orders = table(spark, folder, "orders")
    raw = F.concat(
        F.lit('{"FilelD":{"type":"File","value":"f'), F.col("o_custkey").cast("string"), F.lit('"},"status":"'),
        F.col("o_orderstatus"), F.lit('","n":{"value":'), F.col("o_custkey").cast("string"), F.lit('},"free":{"type":"x"}'),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(',"FileID":"again"')).otherwise(F.lit("")), F.lit("}"),
    )
    return N.typed_inputs(orders.select("o_orderkey", raw.alias("inputs")), ["o_orderkey"], "inputs")


@query(
    "render_runtime_tokens",
    f"""WITH {RUNS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, seq) AS i FROM runs
) SELECT execution_id, 'run-' || i || '-20250101010101' AS q, 'id-' || i || ' ' || event_type AS nested FROM placed""",
)
def render_runtime_tokens(spark, folder):
    facts = runs(spark, folder).select("workflow_id", "execution_id", "ts", "seq", "inputs")
    placed = with_position(facts, ["workflow_id"], ["ts", "seq"])
    inputs = F.create_map(
        F.lit("q"), F.lit("run-{ID}-{TIME}"), F.lit("nested"), F.concat(F.lit("id-{ID} "), F.col("inputs")["type"])
    )
    as_of = F.to_timestamp_ntz(F.lit("2025-01-01 01:01:01"))
    done = placed.select("execution_id", N.render_runtime_tokens(inputs, F.col("index"), as_of).alias("m"))
    return done.select("execution_id", F.col("m")["q"].alias("q"), F.col("m")["nested"].alias("nested"))


TOOK = "epoch_us(finished_at) - epoch_us(started_at)"


@query(
    "task_result_projection",
    f"""WITH {TASKS_SQL} SELECT task_id, state AS task_status, round(({TOOK}) / 1e6, 6) AS execution_time,
  CASE WHEN state = 'failed' THEN 'own error' WHEN state = 'error' THEN 'from metadata' END AS error_message
FROM tasks WHERE state NOT IN ('pending', 'queued', 'running')""",
)
def task_result_projection(spark, folder):
    done = N.task_result_projection(tasks(spark, folder))
    return done.select("task_id", "task_status", F.round("execution_time", 6).alias("execution_time"), "error_message")


@query(
    "task_to_run",
    f"""WITH {TASKS_SQL} SELECT task_id AS execution_id, workflow_id,
  CASE state WHEN 'succeeded' THEN 'success' WHEN 'failed' THEN 'failed' WHEN 'timeout' THEN 'timeout' ELSE 'error' END AS status,
  round(coalesce(({TOOK}) / 1e6, 0.0), 6) AS execution_time,
  CASE WHEN event_type = 'view' THEN 0 ELSE k * 5 END AS tokens_used,
  round(CASE WHEN event_type = 'view' THEN 0.0 ELSE value / CAST(1000 AS DOUBLE) END, 6) AS cost,
  'v' || (event_id % 3) AS prompt_variant, CAST(k % 4 + 1 AS VARCHAR) AS attempts
FROM tasks""",
)
def task_to_run(spark, folder):
    took = M.seconds_between(F.col("started_at"), F.col("finished_at"))
    results = tasks(spark, folder).withColumn("execution_time", F.coalesce(took, F.lit(0.0)))
    return N.task_to_run(results).select(
        "execution_id", "workflow_id", "status", F.round("execution_time", 6).alias("execution_time"), "tokens_used",
        F.round("cost", 6).alias("cost"), "prompt_variant", F.col("metadata")["attempt_count"].alias("attempts"),
    )


@query(
    "can_retry",
    f"""WITH {TASKS_SQL} SELECT task_id, state IN ('failed', 'timeout', 'error') AND k % 4 + 1 <= 2 AS can_retry FROM tasks""",
)
def can_retry(spark, folder):
    verdict = N.can_retry(F.col("task_status"), F.col("attempt_count"), F.lit(2))
    return tasks(spark, folder).select("task_id", verdict.alias("can_retry"))


@query(
    "run_statistics",
    f"""WITH {TASKS_SQL}, t AS (
  SELECT *, coalesce(({TOOK}) / 1e6, 0.0) AS took, CASE WHEN event_type <> 'view' THEN k * 5 END AS tokens FROM tasks
) SELECT workflow_id, count(*) AS total_tasks, count(*) FILTER (state = 'succeeded') AS succeeded_tasks,
  count(*) FILTER (state = 'failed') AS failed_tasks, count(*) FILTER (state = 'timeout') AS timeout_tasks,
  count(*) FILTER (state = 'cancelled') AS cancelled_tasks, count(*) FILTER (state = 'error') AS error_tasks,
  count(*) FILTER (state IN ('succeeded', 'failed', 'timeout', 'error')) AS completed_tasks,
  round(count(*) FILTER (state = 'succeeded') /
    CAST(count(*) FILTER (state IN ('succeeded', 'failed', 'timeout', 'error')) AS DOUBLE), 6) AS success_rate,
  round(sum(took) / count(*) FILTER (state IN ('succeeded', 'failed', 'timeout', 'error')), 6) AS avg_execution_time,
  round(sum(took), 6) AS total_execution_time, CAST(sum(k % 4) AS BIGINT) AS total_retries,
  CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(CASE WHEN event_type <> 'view' THEN value / CAST(1000 AS DOUBLE) END), 6) AS total_cost
FROM t GROUP BY workflow_id""",
)
def run_statistics(spark, folder):
    took = M.seconds_between(F.col("started_at"), F.col("finished_at"))
    results = tasks(spark, folder).withColumn("execution_time", F.coalesce(took, F.lit(0.0)))
    stats = M.run_statistics(results, ["workflow_id"])
    return stats.withColumns(
        {c: F.round(c, 6) for c in ("success_rate", "avg_execution_time", "total_execution_time", "total_cost")}
    )


@query(
    "run_duration",
    f"""WITH {TASKS_SQL} SELECT workflow_id, round((epoch_us(max(finished_at)) - epoch_us(min(started_at))) / 1e6, 6) AS total_duration
FROM tasks GROUP BY workflow_id""",
)
def run_duration(spark, folder):
    spans = M.run_duration(tasks(spark, folder), ["workflow_id"])
    return spans.select("workflow_id", F.round("total_duration", 6).alias("total_duration"))


@query(
    "union_runs",
    f"""WITH {TASKS_SQL} SELECT 'wf_' || (user_id % 10) AS workflow_id, 'exec_' || event_id AS execution_id, CAST(NULL AS VARCHAR) AS error_message FROM events
UNION ALL SELECT workflow_id, task_id, CASE WHEN state = 'failed' THEN 'own error' END FROM tasks""",
)
def union_runs(spark, folder):
    recorded = runs(spark, folder).select("workflow_id", "execution_id")
    executed = tasks(spark, folder).select("workflow_id", F.col("task_id").alias("execution_id"), "error_message")
    return N.union_runs(recorded, executed)


CATALOG_SQL = "SELECT 'supplier_' || s_suppkey AS id, 'nation_' || s_nationkey AS tag FROM supplier"


def catalog(spark, folder):
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.array(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")), F.lit("all")).alias("tags"),
    )


@query("discover_workflows", f"SELECT id FROM ({CATALOG_SQL}) WHERE tag = 'nation_5'")
def discover_workflows(spark, folder):
    return N.discover_workflows(catalog(spark, folder), tag="nation_5").select("id")


@query("enabled_workflows", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0")
def enabled_workflows(spark, folder):
    plan = table(spark, folder, "supplier").withColumn("enabled", F.when(F.col("s_acctbal") < 0, False))
    return N.enabled_workflows(plan).select("s_suppkey")


@query(
    "validate_runs",
    f"""WITH {RUNS_SQL} SELECT seq, CASE k WHEN 13 THEN 'workflow_id is required' WHEN 14 THEN 'execution_id is required'
  WHEN 15 THEN 'execution_time must be non-negative' WHEN 16 THEN 'tokens_used must be non-negative'
  WHEN 17 THEN 'cost must be non-negative' END AS reason FROM runs""",
)
def validate_runs(spark, folder):
    k = F.col("tokens_used") / 5
    raw = (
        runs(spark, folder)
        .withColumn("workflow_id", F.when(k != 13, F.col("workflow_id")))
        .withColumn("execution_id", F.when(k == 14, "").otherwise(F.col("execution_id")))
        .withColumn("execution_time", F.when(k == 15, F.lit(-1.0)).otherwise(F.col("execution_time")))
        .withColumn("cost", F.when(k == 17, F.lit(-0.5)).otherwise(F.col("cost")))
        .withColumn("tokens_used", F.when(k == 16, F.lit(-1)).otherwise(F.col("tokens_used")))
    )
    valid, rejected = V.validate_runs(raw)
    return valid.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("seq", "reason"))


@query(
    "validate_thresholds",
    """WITH t AS (SELECT p_partkey, p_size, p_partkey % 7 AS m FROM part)
SELECT p_partkey, CASE
  WHEN m = 1 THEN 'missing threshold for good' WHEN m = 2 THEN 'token_efficiency for fair must be in (0, 1]'
  WHEN m = 3 THEN 'execution_time must rise from excellent to fair'
  WHEN m = 4 THEN 'token_efficiency must fall from excellent to fair'
  WHEN m = 5 THEN 'missing execution_time for excellent'
  WHEN m = 6 THEN 'execution_time for excellent must be positive' END AS reason FROM t""",
)
def validate_thresholds(spark, folder):
    m, size = F.col("p_partkey") % 7, F.col("p_size").cast("double")
    grades = F.array(
        F.struct(
            F.lit("excellent").alias("grade"),
            F.when(m == 6, F.lit(0.0)).when(m != 5, size + 1).alias("execution_time"),
            F.lit(0.8).alias("token_efficiency"),
        ),
        F.struct(
            F.when(m == 1, "other").otherwise("good").alias("grade"),
            F.when(m == 3, size).otherwise(size + 2).alias("execution_time"),
            F.when(m == 4, 0.9).otherwise(0.6).alias("token_efficiency"),
        ),
        F.struct(
            F.lit("fair").alias("grade"),
            (size + 3).alias("execution_time"),
            F.when(m == 2, 1.5).otherwise(0.4).alias("token_efficiency"),
        ),
    )
    return V.validate_thresholds(table(spark, folder, "part").select("p_partkey", F.inline(grades)), "p_partkey")


@query(
    "validate_plan_refs",
    """WITH plan AS (SELECT 'NATION_' || (c_custkey % 30) AS catalog_id, c_mktsegment AS a, 'ds_' || (c_custkey % 11) AS b FROM customer),
refs AS (SELECT catalog_id, a AS ref FROM plan UNION SELECT catalog_id, b FROM plan)
SELECT DISTINCT catalog_id, 'workflow' AS kind, catalog_id AS ref FROM plan WHERE catalog_id NOT IN (SELECT n_name FROM nation)
UNION ALL SELECT catalog_id, 'dataset', ref FROM refs
WHERE ref NOT IN (SELECT 'ds_' || n_nationkey FROM nation WHERE n_nationkey < 9 UNION SELECT 'BUILDING')""",
)
def validate_plan_refs(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    plan = customer.select(
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("catalog_id"),
        F.array("c_mktsegment", F.concat(F.lit("ds_"), (F.col("c_custkey") % 11).cast("string"))).alias("dataset_refs"),
    )
    key = F.col("n_nationkey")
    known = nation.select(
        F.when(key < 9, F.concat(F.lit("ds_"), key.cast("string"))).otherwise("BUILDING").alias("dataset")
    )
    return V.validate_plan_refs(plan, nation.select(F.col("n_name").alias("id")), known)


@query(
    "validate_variants",
    """WITH v AS (SELECT 'wf_' || (p_partkey % 200) AS workflow_id, p_brand AS variant_id, 'Brand#' || p_size AS fallback FROM part)
SELECT workflow_id, variant_id AS ref, 'duplicate variant' AS problem FROM v GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT workflow_id, fallback, 'unknown fallback' FROM v
WHERE (workflow_id, fallback) NOT IN (SELECT (workflow_id, variant_id) FROM v)""",
)
def validate_variants(spark, folder):
    variants = table(spark, folder, "part").select(
        F.concat(F.lit("wf_"), (F.col("p_partkey") % 200).cast("string")).alias("workflow_id"),
        F.col("p_brand").alias("variant_id"),
        F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("fallback_variant"),
    )
    return V.validate_variants(variants)


@query(
    "validate_input_multiplicity",
    """WITH i AS (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN 1 + CAST(l_quantity AS BIGINT) // 40 END AS n FROM lineitem),
w AS (SELECT l_orderkey, min(n) AS low, max(n) AS high FROM i GROUP BY 1),
r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 + o_custkey % 2 END AS n FROM orders)
SELECT 'order_' || w.l_orderkey AS workflow_id, low AS expected_length,
  CASE WHEN low < high THEN 'list inputs differ in length' WHEN low IS NOT NULL AND r.n <> low THEN 'reference length differs' END AS reason
FROM w LEFT JOIN r ON r.o_orderkey = w.l_orderkey""",
)
def validate_input_multiplicity(spark, folder):
    inputs = table(spark, folder, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("workflow_id"),
        (F.col("l_linenumber") > 1).alias("is_list"),
        F.array_repeat("l_returnflag", F.expr("cast(1 + cast(l_quantity as bigint) div 40 as int)")).alias("values"),
    )
    references = table(spark, folder, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("workflow_id"),
        (F.col("o_orderstatus") == "F").alias("is_list"),
        F.array_repeat("o_orderpriority", (1 + F.col("o_custkey") % 2).cast("int")).alias("values"),
    )
    return V.validate_input_multiplicity(inputs, references)

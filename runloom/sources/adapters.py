"""Domain tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def run_status(event_type: Column, k: Column) -> Column:
    return (
        F.when(event_type.isin("click", "view", "purchase"), "success")
        .when(event_type == "signup", "failed")
        .when(k < 30, "timeout")
        .otherwise("error")
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run facts from ``events``: one row per event."""
    return runs_of(table(spark, folder, "events"))


def stream_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same run facts as a stream of the ``events`` file."""
    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return runs_of(source)


def runs_of(events: DataFrame) -> DataFrame:
    events = events.withColumn("k", _k())
    status = run_status(F.col("event_type"), F.col("k"))
    return events.select(
        F.concat(F.lit("wf_"), (F.col("user_id") % 10).cast("string")).alias("workflow_id"),
        F.concat(F.lit("exec_"), F.col("event_id").cast("string")).alias("execution_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        status.alias("status"),
        (F.col("value") / F.lit(20.0)).alias("execution_time"),
        (F.col("k") * 5).alias("tokens_used"),
        ((F.col("k") * 5).cast("double") * F.lit(0.00002)).alias("cost"),
        F.create_map(F.lit("type"), F.col("event_type")).alias("inputs"),
        F.create_map(
            F.lit("text"), F.expr("repeat(event_type, cast(1 + event_id % 97 as int))")
        ).alias("outputs"),
        F.when(status != "success", F.concat(status, F.lit(" in "), F.col("event_type"))).alias("error_message"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))).alias(
            "prompt_variant"
        ),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("ds_"), (F.col("event_id") % 5).cast("string"))).alias(
            "dataset"
        ),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
    )


RUNS_SQL = """
ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events
),
runs AS (
  SELECT 'wf_' || (user_id % 10) AS workflow_id,
         'exec_' || event_id AS execution_id,
         event_id AS seq,
         ts,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'success'
              WHEN event_type = 'signup' THEN 'failed'
              WHEN k < 30 THEN 'timeout' ELSE 'error' END AS status,
         value / CAST(20 AS DOUBLE) AS execution_time,
         k * 5 AS tokens_used,
         CAST(k * 5 AS DOUBLE) * CAST(0.00002 AS DOUBLE) AS cost,
         event_type,
         repeat(event_type, CAST(1 + event_id % 97 AS BIGINT)) AS output_text,
         CASE WHEN event_id % 3 <> 0 THEN 'v' || (event_id % 3) END AS prompt_variant,
         CASE WHEN event_id % 4 <> 0 THEN 'ds_' || (event_id % 5) END AS dataset,
         user_id, event_id, k, value
  FROM ev
)"""


def text_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with long outputs from ``documents``: one run per document, one workflow per source."""
    docs = table(spark, folder, "documents")
    verdicts = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return docs.join(verdicts, "doc_id", "left").select(
        F.concat(F.lit("wf_"), F.col("source")).alias("workflow_id"),
        F.col("doc_id").alias("index"),
        F.when(F.col("quality") == 0, "failed")
        .when(F.col("toxic") == 1, "timeout")
        .otherwise("success")
        .alias("status"),
        F.col("text").alias("output_text"),
        (F.col("n_chars") / F.lit(1000.0)).alias("duration_seconds"),
        F.col("lang"),
    )


TEXT_RUNS_SQL = """
samples AS (
  SELECT 'wf_' || d.source AS workflow_id,
         d.doc_id AS "index",
         CASE WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'timeout' ELSE 'success' END AS status,
         d.text AS output_text,
         d.n_chars / CAST(1000 AS DOUBLE) AS duration_seconds,
         d.lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def _quoted(*parts: Column | str) -> Column:
    """Concatenate literal pieces and columns into JSON text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Schemaless run payloads, in the shapes services answer with, one per event."""
    events = table(spark, folder, "events").withColumn("k", _k())
    k, kind, text = F.col("k"), F.col("event_type"), _quoted("out ", F.col("event_id"))
    body = (
        F.when(kind == "click", _quoted('{"status":" Completed ","output":"', text, '","metrics":{"duration_seconds":', k, "}}"))
        .when(
            kind == "view",
            _quoted(
                '{"result":{"data":{"status":"succeeded","state":"x"}},"output":{"text":"', text,
                '"},"inputs":{"q":"u', F.col("user_id"), '"}}',
            ),
        )
        .when(
            kind == "purchase",
            _quoted('{"data":{"inputs":{"q":"p"},"metrics":{"duration_seconds":', k, '},"state":"partial"},"response":"', text, '"}'),
        )
        .when((kind == "signup") & (k % 2 == 0), _quoted('{"output":"', text, '"}'))
        .when(kind == "signup", F.lit('{"input":"a","state":"Weird"}'))
        .when(k < 30, F.lit('{"state":"Timed_Out","result":{"status":"FAILED","text":"boom"}}'))
        .when(k < 60, F.lit('{"data":{"request":"r"},"status":"cancelled"}'))
        .when(k < 80, F.lit('{"note":"n"}'))
        .otherwise(F.lit("not json"))
    )
    return events.select(
        F.concat(F.lit("wf_"), (F.col("user_id") % 10).cast("string")).alias("workflow_id"),
        "event_id", "ts", body.alias("payload"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task records in all eight states, one per event."""
    events = table(spark, folder, "events").withColumn("k", _k())
    k, kind = F.col("k"), F.col("event_type")
    state = (
        F.when(kind.isin("click", "view"), "succeeded")
        .when(kind == "purchase", F.element_at(F.array(*map(F.lit, ("pending", "queued", "running", "cancelled"))), (k % 4 + 1).cast("int")))
        .when(kind == "signup", "failed")
        .when(k < 30, "timeout")
        .otherwise("error")
    )
    started = F.when(~state.isin("pending", "queued"), F.expr("ts + make_dt_interval(0, 0, 0, 1)"))
    finished = F.when(~state.isin("pending", "queued", "running"), F.expr("ts + make_dt_interval(0, 0, 0, 1 + k)"))
    return events.select(
        F.concat(F.lit("task_"), F.col("event_id").cast("string")).alias("task_id"),
        F.concat(F.lit("wf_"), (F.col("user_id") % 10).cast("string")).alias("workflow_id"),
        F.concat(F.lit("ds_"), (F.col("event_id") % 5).cast("string")).alias("dataset"),
        F.lit("normal").alias("scenario"),
        state.alias("task_status"),
        (k % 4 + 1).cast("int").alias("attempt_count"),
        F.col("ts").alias("created_at"),
        started.alias("started_at"),
        finished.alias("finished_at"),
        F.when(state == "failed", F.lit("own error")).alias("error_message"),
        F.when(kind != "view", k * 5).alias("tokens_used"),
        F.when(kind != "view", F.col("value") / F.lit(1000.0)).alias("cost"),
        F.create_map(F.lit("prompt_variant"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")),
                     F.lit("error_message"), F.when(state == "error", F.lit("from metadata"))).alias("metadata"),
        F.col("event_id").alias("seq"),
    )


TASKS_SQL = """
ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events
),
tasks AS (
  SELECT *, CASE WHEN state NOT IN ('pending', 'queued') THEN ts + INTERVAL 1 SECOND END AS started_at,
         CASE WHEN state NOT IN ('pending', 'queued', 'running') THEN ts + to_seconds(1 + k) END AS finished_at
  FROM (
    SELECT *, 'task_' || event_id AS task_id, 'wf_' || (user_id % 10) AS workflow_id,
           CASE WHEN event_type IN ('click', 'view') THEN 'succeeded'
                WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'pending'
                WHEN event_type = 'purchase' AND k % 4 = 1 THEN 'queued'
                WHEN event_type = 'purchase' AND k % 4 = 2 THEN 'running'
                WHEN event_type = 'purchase' THEN 'cancelled'
                WHEN event_type = 'signup' THEN 'failed'
                WHEN k < 30 THEN 'timeout' ELSE 'error' END AS state
    FROM ev
  )
)"""


def _tagged(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Plan datasets, one per supplier."""
    return table(spark, folder, "supplier").select(
        _tagged("ds_", F.col("s_suppkey")).alias("dataset"), F.lit("normal").alias("scenario"), "s_suppkey", "s_acctbal"
    )


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Five parameters per dataset: a list, a range, a fixed list, a default and a list that may be empty."""
    key = F.col("s_suppkey")
    none_list, none_long, none_text = F.lit(None).cast("array<string>"), F.lit(None).cast("long"), F.lit(None).cast("string")

    def row(ordinal, name, values=none_list, low=none_long, high=none_long, step=none_long, default=none_text, pairwise=True):
        return F.struct(
            F.lit(ordinal).alias("ordinal"), F.lit(name).alias("param"), values.alias("values"), low.alias("min"),
            high.alias("max"), step.alias("step"), default.alias("default"), F.lit(pairwise).alias("pairwise"),
        )

    tone = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    topic = F.when(key % 5 != 0, F.array(F.lit("a"), F.lit("b")))
    rows = F.array(
        row(0, "tone", values=tone),
        row(1, "length", low=F.lit(1).cast("long"), high=1 + key % 9, step=1 + key % 3),
        row(2, "lang", values=F.array(F.lit("en"), F.lit("fr"), F.lit("de"))),
        row(3, "temperature", default=F.lit("0.7"), pairwise=False),
        row(4, "topic", values=topic),
    )
    return datasets(spark, folder).select("dataset", F.inline(rows))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Two conversation flows for every dataset of a supplier with a low balance."""
    titles = F.when(F.col("s_acctbal") < 1500, F.array(F.lit("greeting"), F.lit("complaint")))
    return datasets(spark, folder).select("dataset", F.posexplode(titles).alias("flow_no", "title"))


def plan(spark: SparkSession, folder: str) -> DataFrame:
    """Plan workflows, one per customer: two dataset references, up to two variants, some disabled."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        _tagged("flow_", key).alias("catalog_id"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.array(_tagged("ds_", key % 97), _tagged("ds_", key % 100 + 50)).alias("dataset_refs"),
        F.when(key % 3 != 0, F.slice(F.array(F.lit("base"), F.lit("long")), F.lit(1), (key % 3).cast("int"))).alias("variants"),
    )


PLAN_SQL = """
ds AS (SELECT s_suppkey AS sk, s_acctbal AS balance, 'ds_' || s_suppkey AS dataset FROM supplier),
dim AS (
  SELECT dataset, sk, 0 AS ordinal, 'tone' AS param, 't' || i AS v, i AS pos FROM ds, range(0, 4) r(i) WHERE i <= sk % 4
  UNION ALL SELECT dataset, sk, 1, 'length', CAST(1 + i * (1 + sk % 3) AS VARCHAR), i FROM ds, range(0, 20) r(i)
    WHERE 1 + i * (1 + sk % 3) < 1 + sk % 9 + 1 + sk % 3
  UNION ALL SELECT dataset, sk, 2, 'lang', CASE i WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END, i FROM ds, range(0, 3) r(i)
  UNION ALL SELECT dataset, sk, 3, 'temperature', '0.7', 0 FROM ds
  UNION ALL SELECT dataset, sk, 4, 'topic', CASE i WHEN 0 THEN 'a' ELSE 'b' END, i FROM ds, range(0, 2) r(i) WHERE sk % 5 <> 0
),
fl AS (SELECT dataset, i AS flow_no, CASE i WHEN 0 THEN 'greeting' ELSE 'complaint' END AS title
       FROM ds, range(0, 2) r(i) WHERE balance < 1500),
refs AS (
  SELECT 'flow_' || c_custkey AS catalog_id, c_custkey AS ck, c_acctbal >= 0 AS enabled, i AS ref_order,
         'ds_' || CASE i WHEN 0 THEN c_custkey % 97 ELSE c_custkey % 100 + 50 END AS dataset
  FROM customer, range(0, 2) r(i)
),
vars AS (
  SELECT 'flow_' || c_custkey AS catalog_id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN i = 0 THEN 'base' ELSE 'long' END AS variant_id
  FROM customer, range(0, 2) r(i) WHERE i < greatest(c_custkey % 3, 1)
)"""


def reference_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Reference of a workflow from each ``benchmark`` item; some of these workflows have no runs."""
    item = F.col("item_id")
    return table(spark, folder, "benchmark").select(
        _tagged("wf_src", item).alias("workflow_id"),
        F.array("text").alias("expected_outputs"),
        F.array(F.lit("the "), F.lit("Return JSON"), _tagged("zq", item)).alias("constraints"),
        F.lit(0.72).alias("similarity_threshold"),
        (F.lit(0.05) * (item % 4)).alias("max_failure_rate"),
        F.when(item % 3 != 0, item.cast("double") + 5.0).alias("max_latency_seconds"),
    )


SPECS_SQL = """
specs AS (
  SELECT 'wf_src' || item_id AS workflow_id, text AS expected, item_id,
         CAST(0.05 AS DOUBLE) * (item_id % 4) AS max_failure_rate,
         CASE WHEN item_id % 3 <> 0 THEN CAST(item_id AS DOUBLE) + 5.0 END AS max_latency_seconds
  FROM benchmark
)"""


def dsl_trees(spark: SparkSession, folder: str) -> DataFrame:
    """One workflow definition per document, as VARIANT."""
    return trees_of(table(spark, folder, "documents"))


def trees_of(docs: DataFrame) -> DataFrame:
    """Definitions in three shapes from ``doc_id, lang, source, text``."""
    lang, source = F.col("lang"), F.col("source")

    def message(role: str | None, text: Column | None) -> Column:
        fields = [] if role is None else [F.lit(role).alias("role")]
        return F.to_json(F.struct(*fields, *([] if text is None else [text.alias("text")])))

    def joined(*items: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))

    first = F.concat(
        F.lit('{"id":"a","type":"llm","data":{"title":"Writer","role":"author","inputs":{"x":1},"output_schema":{"y":1},'
              '"prompt_template":{"messages":'),
        joined(
            message("system", F.concat(F.lit("You write "), lang, F.lit(" {{ lang }}"))), message("user", F.col("text")), message("user", None)
        ),
        F.lit("}}}"),
    )
    second = F.concat(
        F.lit('{"id":"b","type":"llm","data":{"label":"Checker","prompt_template":'),
        joined(message("user", F.concat(F.lit("Check ${"), source, F.lit("}"))), message(None, source)),
        F.lit("}}"),
    )
    third = F.concat(F.lit('{"type":"code","data":{"system_prompt":"sys '), lang, F.lit('"}}'))
    nodes = joined(first, second, third, F.lit("7"))
    extra = F.lit('[{"id":"d","type":"llm","data":{"prompt_template":{"messages":[]}}},{"id":"e","data":{"system_prompt":"tail"}}]')
    key = F.col("doc_id") % 3
    tree = (
        F.when(key == 0, F.concat(F.lit('{"graph":{"nodes":'), nodes, F.lit("}}")))
        .when(key == 1, F.concat(F.lit('{"graph":3,"workflow":{"graph":{"nodes":'), nodes, F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"graph":{"nodes":'), nodes, F.lit(',"data":'), extra, F.lit("}}")))
    )
    return docs.select("doc_id", "lang", "source", F.try_parse_json(tree).alias("tree"))


LOCATIONS_SQL = """
d AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN '/workflow/graph' ELSE '/graph' END AS g FROM documents),
loc AS (
  SELECT doc_id, lang, source, 'a' AS node_id, 0 AS node_no, 0 AS bucket_no, 0 AS message_no, 0 AS idx, 'system' AS role,
         g || '/nodes/0/data/prompt_template/messages/0/text' AS path, 'You write ' || lang || ' {{ lang }}' AS text FROM d
  UNION ALL SELECT doc_id, lang, source, 'a', 0, 0, 1, 1, 'user', g || '/nodes/0/data/prompt_template/messages/1/text', text FROM d
  UNION ALL SELECT doc_id, lang, source, 'b', 1, 0, 0, 0, 'user', g || '/nodes/1/data/prompt_template/0/text', 'Check ${' || source || '}' FROM d
  UNION ALL SELECT doc_id, lang, source, 'b', 1, 0, 1, 1, 'user', g || '/nodes/1/data/prompt_template/1/text', source FROM d
  UNION ALL SELECT doc_id, lang, source, 'node_2', 2, 0, 0, 0, 'system', g || '/nodes/2/data/system_prompt', 'sys ' || lang FROM d
  UNION ALL SELECT doc_id, lang, source, 'e', 1, 1, 0, 0, 'system', g || '/data/1/data/system_prompt', 'tail' FROM d WHERE doc_id % 3 = 2
)"""

"""Queries over token usage, versions and prompt variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import usage as U
from runloom.plans.history import TRIALS_SQL, trials
from runloom.plans.registry import query
from runloom.sources.adapters import table

REQUESTS_SQL = """WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
req AS (
  SELECT event_id, ts, k * 10 AS input_tokens, k AS output_tokens, value AS latency_ms,
    k * 10 / CAST(1000 AS DOUBLE) * CAST(CASE event_type WHEN 'click' THEN 0.01 WHEN 'view' THEN 0.03 WHEN 'purchase' THEN 0.0005 WHEN 'signup' THEN 0.015 ELSE 0.003 END AS DOUBLE)
    + k / CAST(1000 AS DOUBLE) * CAST(CASE event_type WHEN 'click' THEN 0.03 WHEN 'view' THEN 0.06 WHEN 'purchase' THEN 0.0015 WHEN 'signup' THEN 0.075 ELSE 0.015 END AS DOUBLE) AS cost
  FROM e
)"""


def requests(spark, folder):
    """One priced request per event, a model per event type."""
    models = F.create_map(
        *[F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "error"), U.PRICES) for x in pair]
    )
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, folder, "events").select(
        "event_id", "ts", models[F.col("event_type")].alias("model"), (k * 10).alias("input_tokens"), k.alias("output_tokens"),
        F.col("value").alias("latency_ms"),
    )
    return rows.withColumn("cost", U.usage_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


@query("usage_cost", f"{REQUESTS_SQL} SELECT event_id, round(cost, 6) AS cost FROM req")
def usage_cost(spark, folder):
    return requests(spark, folder).select("event_id", F.round("cost", 6).alias("cost"))


@query(
    "usage_stats",
    f"""{REQUESTS_SQL} SELECT count(*) AS request_count, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  round(sum(cost), 6) AS total_cost, round(avg(latency_ms), 6) AS average_latency_ms FROM req""",
)
def usage_stats(spark, folder):
    stats = U.usage_stats(requests(spark, folder))
    return stats.withColumns({c: F.round(c, 6) for c in ("total_cost", "average_latency_ms")})


@query(
    "daily_cost",
    f"""{REQUESTS_SQL} SELECT round(sum(cost), 6) AS daily_cost FROM req
WHERE ts > TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'""",
)
def daily_cost(spark, folder):
    as_of = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    return U.daily_cost(requests(spark, folder), as_of).select(F.round("daily_cost", 6).alias("daily_cost"))


@query("recent_requests", f"{REQUESTS_SQL} SELECT event_id, round(cost, 6) AS cost FROM req ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_requests(spark, folder):
    return U.recent_requests(requests(spark, folder), 25, "event_id").select("event_id", F.round("cost", 6).alias("cost"))


@query(
    "version_bump",
    f"""{TRIALS_SQL}, g AS (SELECT node_id, step, total % 20 AS gain, row_number() OVER (PARTITION BY node_id ORDER BY step) AS rn FROM trials),
m AS (SELECT *, count(*) FILTER (rn > 1 AND gain >= 15) OVER (PARTITION BY node_id ORDER BY step) AS ma FROM g),
n AS (SELECT *, count(*) FILTER (rn > 1 AND gain >= 5 AND gain < 15) OVER (PARTITION BY node_id, ma ORDER BY step) AS mi FROM m),
p AS (SELECT *, count(*) FILTER (rn > 1 AND gain < 5) OVER (PARTITION BY node_id, ma, mi ORDER BY step) AS pa FROM n)
SELECT node_id, step, (ma + 1) || '.' || mi || '.' || pa AS version FROM p""",
)
def version_bump(spark, folder):
    changes = trials(spark, folder).select("node_id", "step", (F.col("total") % 20).alias("improvement"))
    return U.version_bump(changes, "node_id").select("node_id", "step", "version")


@query(
    "prompt_variables",
    """SELECT doc_id, lang || ',user.' || source || ',context.data,workflow.id' AS variables, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'workflow.id' END AS missing FROM documents""",
)
def prompt_variables(spark, folder):
    head = F.concat(
        F.lit("{{"), "lang", F.lit("}} {{ user."), "source", F.lit(" }} {{#context.data#}} {{"), "lang", F.lit("}} ")
    )
    docs = table(spark, folder, "documents")
    old = F.concat(head, "text", F.lit(" {{$workflow.id}}"))
    new = F.when(F.col("doc_id") % 2 == 0, old).otherwise(F.concat(head, "text"))
    wanted = docs.select("doc_id", U.prompt_variables(old).alias("v"), new.alias("new"))
    return wanted.select(
        "doc_id", F.array_join("v", ",").alias("variables"), F.array_join(U.missing_variables(F.col("new"), F.col("v")), ",").alias("missing")
    )

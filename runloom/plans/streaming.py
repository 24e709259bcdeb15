"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.plans.files import fresh
from runloom.plans.registry import query
from runloom.sources import adapters as A
from runloom.sources.adapters import RUNS_SQL, table
from runloom.streaming.collect import RANK_ERROR, snapshot, stream_collect
from runloom.streaming.rate_limit import rate_limit_admission


@query(
    "stream_collect",
    f"""WITH {RUNS_SQL} SELECT workflow_id, count(*) AS total_executions, count(*) FILTER (status = 'success') AS successful_count,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens, round(avg(execution_time), 6) AS avg_execution_time, true AS p95_within_error FROM runs GROUP BY 1""",
)
def stream_collect_query(spark, folder):
    out = fresh(spark, "stream")
    stream = stream_collect(A.stream_runs(spark, folder), f"{out}/statistics", f"{out}/checkpoint")
    stream.awaitTermination()
    stats = snapshot(spark, f"{out}/statistics").withColumn("avg_execution_time", F.round("avg_execution_time", 6))
    # the share of runs below the sketch's percentile and up to it, held against its rank
    times = A.runs(spark, folder).select("workflow_id", "execution_time")
    p95 = F.col("p95_execution_time_approx")
    near = times.join(stats.select("workflow_id", p95), "workflow_id").groupBy("workflow_id").agg(
        F.avg((F.col("execution_time") < p95).cast("double")).alias("below"), F.avg((F.col("execution_time") <= p95).cast("double")).alias("upto")
    )
    room = 2 * RANK_ERROR
    within = ((F.col("below") <= 0.95 + room) & (F.col("upto") >= 0.95 - room)).alias("p95_within_error")
    return stats.join(near, "workflow_id").select("workflow_id", "total_executions", "successful_count", "total_tokens", "avg_execution_time", within)


@query(
    "rate_limit_admission",
    # one step per request of a user, all users side by side
    """WITH RECURSIVE r AS (
  SELECT user_id, event_id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS sec, 1 + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 4 AS need,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), w AS (
  SELECT user_id, event_id, n, sec, need, true AS admitted, CAST(5 - need AS DOUBLE) AS tokens FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.n, r.sec, r.need,
    least(5.0, w.tokens + CAST(0.05 AS DOUBLE) / 60 * (r.sec - w.sec)) >= r.need,
    least(5.0, w.tokens + CAST(0.05 AS DOUBLE) / 60 * (r.sec - w.sec))
      - CASE WHEN least(5.0, w.tokens + CAST(0.05 AS DOUBLE) / 60 * (r.sec - w.sec)) >= r.need THEN r.need ELSE 0 END
  FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1
) SELECT user_id, event_id, admitted, round(tokens, 4) AS tokens_left,
  CASE WHEN admitted THEN 0.0 ELSE round((need - tokens) / (CAST(0.05 AS DOUBLE) / 60), 2) END AS wait_seconds FROM w""",
)
def rate_limit_admission_query(spark, folder):
    requests = table(spark, folder, "events").select(
        "user_id", "event_id", "ts", (1 + F.get_json_object("props", "$.k").cast("int") % 4).alias("tokens")
    )
    done = rate_limit_admission(requests, "user_id", "event_id", per_minute=0.05, burst=5.0)
    return done.select(
        "user_id", "event_id", "admitted", F.round("tokens_left", 4).alias("tokens_left"), F.round("wait_seconds", 2).alias("wait_seconds")
    )

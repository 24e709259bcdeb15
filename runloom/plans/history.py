"""Queries over ordered runs, attempts, trials and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import history as H
from runloom.operators.ordering import with_position
from runloom.plans.registry import query
from runloom.sources import adapters as A
from runloom.sources.adapters import RUNS_SQL, TASKS_SQL, table

PLACED_SQL = f"""WITH {RUNS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, seq) AS "index" FROM runs
)"""
BATCHED_SQL = f"""WITH {TASKS_SQL}, b AS (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, event_id) AS "index" FROM tasks
), batched AS (SELECT *, ("index" - 1) // 10 AS batch FROM b)"""


def placed_runs(spark, folder):
    facts = A.runs(spark, folder).select("workflow_id", "execution_id", "ts", "seq", "status")
    return with_position(facts, ["workflow_id"], ["ts", "seq"])


def batched_tasks(spark, folder):
    rows = A.tasks(spark, folder).select("task_id", "workflow_id", "created_at", "seq", "task_status", "started_at", "finished_at")
    return H.split_batches(with_position(rows, ["workflow_id"], ["created_at", "seq"]), 10)


@query(
    "representative_run",
    f"""{PLACED_SQL} SELECT workflow_id, "index", execution_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY status = 'success', "index") AS r FROM placed) WHERE r = 1""",
)
def representative_run(spark, folder):
    return H.representative_run(placed_runs(spark, folder)).select("workflow_id", "index", "execution_id", "status")


@query("split_batches", f"{PLACED_SQL} SELECT execution_id, ((\"index\" - 1) // 10) AS batch FROM placed")
def split_batches(spark, folder):
    return H.split_batches(placed_runs(spark, folder), 10).select("execution_id", "batch")


@query(
    "stop_max_failures",
    f"""{BATCHED_SQL}, per AS (
  SELECT workflow_id, batch, count(*) FILTER (state IN ('failed', 'error', 'timeout')) AS f FROM batched GROUP BY 1, 2
), cum AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY workflow_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
SELECT task_id, batch, CASE WHEN before >= 25 THEN 'cancelled' ELSE state END AS final_status,
  CASE WHEN before >= 25 THEN 'Stopped due to stop conditions' END AS stop_message
FROM batched JOIN cum USING (workflow_id, batch)""",
)
def stop_max_failures(spark, folder):
    return H.stop_max_failures(batched_tasks(spark, folder), 25).select("task_id", "batch", "final_status", "stop_message")


@query(
    "stop_timeout",
    f"""{BATCHED_SQL}, per AS (SELECT workflow_id, batch, max(finished_at) AS fin FROM batched GROUP BY 1, 2),
t0 AS (SELECT workflow_id, min(started_at) AS t0 FROM batched GROUP BY 1),
cum AS (SELECT *, max(fin) OVER (PARTITION BY workflow_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM per)
SELECT task_id, batch, CASE WHEN coalesce(epoch_us(upto) - epoch_us(t0) >= 864000000000, false) THEN 'cancelled' ELSE state END AS final_status
FROM batched JOIN cum USING (workflow_id, batch) JOIN t0 USING (workflow_id)""",
)
def stop_timeout(spark, folder):
    return H.stop_timeout(batched_tasks(spark, folder), 864000.0).select("task_id", "batch", "final_status")


ATTEMPTS_SQL = f"""WITH {RUNS_SQL}, attempts AS (
  SELECT 'task_' || event_id AS task_id, a AS attempt,
         CASE WHEN a = 1 + k % 3 AND status = 'success' THEN 'succeeded'
              WHEN (k + a) % 3 = 0 THEN 'failed' WHEN (k + a) % 3 = 1 THEN 'timeout' ELSE 'canceled' END AS status
  FROM runs, range(1, 4) r(a) WHERE a <= 1 + k % 3
)"""


def attempts(spark, folder):
    """One to three attempts per run; the last one of a successful run succeeds."""
    k = F.col("tokens_used") / 5
    facts = A.runs(spark, folder).withColumn("k", k.cast("long"))
    exploded = facts.withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("k") % 3)))
    turn = (F.col("k") + F.col("attempt")) % 3
    last = (F.col("attempt") == 1 + F.col("k") % 3) & (F.col("status") == "success")
    state = F.when(last, "succeeded").when(turn == 0, "failed").when(turn == 1, "timeout").otherwise("canceled")
    return exploded.select(F.concat(F.lit("task_"), F.col("seq").cast("string")).alias("task_id"), "attempt", state.alias("status"))


@query(
    "final_attempt",
    f"""{ATTEMPTS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY status <> 'succeeded',
    CASE WHEN status = 'succeeded' THEN attempt ELSE -attempt END) AS r, count(*) OVER (PARTITION BY task_id) AS attempts FROM attempts)
SELECT task_id, status, attempt, attempts FROM r WHERE r = 1""",
)
def final_attempt(spark, folder):
    return H.final_attempt(attempts(spark, folder))


@query(
    "retry_wait",
    f"""{ATTEMPTS_SQL} SELECT task_id,
  round(sum(CASE WHEN status <> 'succeeded' AND attempt < 3 THEN 2.0 * power(1.5, attempt - 1) ELSE 0.0 END), 6) AS wait_seconds,
  round(sum(CASE WHEN status <> 'succeeded' AND attempt < 3 THEN least(power(2.0, attempt - 1), 5.0) ELSE 0.0 END), 6) AS http_wait_seconds
FROM attempts GROUP BY task_id""",
)
def retry_wait(spark, folder):
    tried = attempts(spark, folder)
    plain = H.retry_wait(tried)
    http = H.retry_wait(tried, http=True).withColumnRenamed("wait_seconds", "http_wait_seconds")
    return plain.join(http, "task_id")


@query(
    "retry_exhausted",
    f"""{ATTEMPTS_SQL} SELECT task_id, 'failed' AS status, 'retry_exhausted' AS error, count(*) AS attempts,
  max(status) FILTER (attempt = 3) AS last_status
FROM attempts GROUP BY task_id HAVING count(*) >= 3 AND bool_and(status <> 'succeeded')""",
)
def retry_exhausted(spark, folder):
    return H.retry_exhausted(attempts(spark, folder), 3, ("timeout", "failed", "error", "canceled"))


# The action types the sample rows cycle through.
KINDS = ("tighten_schema", "add_checkpoint_rule", "modify_checkpoint_rule", "add_global_constraint", "increase_strictness", "rewrite")
ACTIONS_SQL = f"""WITH a AS (
  SELECT l_orderkey AS node_id, l_partkey * 1000 + l_suppkey AS seq, list_element({list(KINDS)}, 1 + l_partkey % 6) AS type,
         't' || (l_suppkey % 3) AS target, l_returnflag || l_partkey AS content, CAST(l_quantity AS BIGINT) % 5 AS evidence_count
  FROM lineitem
), actions AS (SELECT DISTINCT * FROM a)"""
PRIORITY_SQL = """CASE type WHEN 'tighten_schema' THEN 0 WHEN 'add_checkpoint_rule' THEN 1 WHEN 'modify_checkpoint_rule' THEN 1
  WHEN 'add_global_constraint' THEN 2 WHEN 'increase_strictness' THEN 3 ELSE 99 END"""


def action_rows(spark, folder):
    kinds = F.array(*map(F.lit, KINDS))
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("node_id"),
            (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
            F.element_at(kinds, (1 + F.col("l_partkey") % 6).cast("int")).alias("type"),
            F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("target"),
            F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("content"),
            (F.col("l_quantity").cast("long") % 5).alias("evidence_count"),
        )
        .distinct()
    )


@query(
    "limit_actions",
    f"""{ACTIONS_SQL} SELECT node_id, type, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY {PRIORITY_SQL}, seq) AS r FROM actions) WHERE r <= 2""",
)
def limit_actions(spark, folder):
    return H.limit_actions(action_rows(spark, folder), ["node_id"], 2).select("node_id", "type", "seq")


@query(
    "budget_actions",
    f"""{ACTIONS_SQL} SELECT node_id, type, target, content, evidence_count FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY evidence_count DESC, type, target, content, seq) AS r FROM actions) WHERE r <= 2""",
)
def budget_actions(spark, folder):
    kept = H.budget_actions(action_rows(spark, folder), ["node_id"], 2)
    return kept.select("node_id", "type", "target", "content", "evidence_count")


@query(
    "cap_constraints",
    r"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS c FROM documents)
SELECT doc_id, least(len(c), 20) AS kept, c[greatest(len(c) - 19, 1)] AS first_kept, c[len(c)] AS last_kept FROM w""",
)
def cap_constraints(spark, folder):
    capped = table(spark, folder, "documents").select("doc_id", H.cap_constraints(F.split("text", "\n"), H.MAX_CONSTRAINTS).alias("c"))
    return capped.select(
        "doc_id", F.size("c").alias("kept"), F.element_at("c", 1).alias("first_kept"), F.element_at("c", -1).alias("last_kept")
    )


@query(
    "beam_top_k",
    """SELECT c_nationkey AS node_id, c_custkey AS seq, c_acctbal AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""",
)
def beam_top_k(spark, folder):
    candidates = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("node_id"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("score")
    )
    return H.beam_top_k(candidates, ["node_id"], 3)


@query(
    "dedupe_keep_first",
    f"""{ACTIONS_SQL} SELECT type, target, content, min(seq) AS seq FROM actions GROUP BY 1, 2, 3""",
)
def dedupe_keep_first(spark, folder):
    kept = H.dedupe_keep_first(action_rows(spark, folder), ["type", "target", "content"], "seq")
    return kept.select("type", "target", "content", "seq")


TRIALS_SQL = """WITH trials AS (
  SELECT user_id AS node_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, count(*) AS n,
         count(*) FILTER (event_type = 'error') AS issues, count(*) FILTER (event_type = 'signup') AS actions,
         100.0 - 10 * count(*) FILTER (event_type = 'error') - 2 * count(*) FILTER (event_type = 'signup') AS score,
         repeat('p' || (count(*) % 5), 4 + count(*)) AS prompt, count(*) FILTER (event_type = 'error') > 0 AS has_format_issue,
         round(sum(value), 2) AS total
  FROM events GROUP BY 1, 2
)"""


def trials(spark, folder):
    """Step table: one trial per user and day."""
    events = table(spark, folder, "events")
    step = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    folded = events.groupBy(F.col("user_id").alias("node_id"), step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("issues"),
        F.count_if(F.col("event_type") == "signup").alias("actions"),
        F.round(F.sum("value"), 2).alias("total"),
    )
    prompt = F.expr("repeat(concat('p', cast(n % 5 as string)), cast(4 + n as int))")
    return folded.withColumns(
        {
            "score": F.lit(100.0) - F.col("issues") * 10 - F.col("actions") * 2,
            "prompt": prompt,
            "has_format_issue": F.col("issues") > 0,
        }
    )


@query(
    "plateau_detect",
    f"""{TRIALS_SQL}, m AS (
  SELECT *, coalesce(score > max(score) OVER (PARTITION BY node_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM trials
), i AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY step) AS island FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY node_id, island ORDER BY step) - 1 AS stale FROM i),
stops AS (SELECT node_id, min(step) FILTER (stale >= 3) AS stop_step FROM s GROUP BY 1)
SELECT node_id, stop_step, arg_min(step, (-score, step)) AS best_step, CAST(max(score) AS DOUBLE) AS best_score
FROM s JOIN stops USING (node_id) WHERE stop_step IS NULL OR step <= stop_step GROUP BY 1, 2""",
)
def plateau_detect(spark, folder):
    return H.plateau_detect(trials(spark, folder), "node_id")


@query(
    "loop_detect",
    f"""{TRIALS_SQL} SELECT node_id, min(step) AS loop_step FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id, sha256(prompt) ORDER BY step) AS r FROM trials) WHERE r = 2 GROUP BY 1""",
)
def loop_detect(spark, folder):
    return H.loop_detect(trials(spark, folder), "node_id")


@query(
    "growth_guard",
    f"""{TRIALS_SQL}, f AS (SELECT *, first_value(length(prompt)) OVER (PARTITION BY node_id ORDER BY step) AS len0 FROM trials)
SELECT node_id, min(step) FILTER (length(prompt) > floor(len0 * 1.5)) AS stop_step FROM f GROUP BY 1""",
)
def growth_guard(spark, folder):
    return H.growth_guard(trials(spark, folder), "node_id")


@query(
    "stage_progress",
    f"""{TRIALS_SQL}, o AS (SELECT node_id, step, NOT has_format_issue AS clean, row_number() OVER w AS rn,
    min(CASE WHEN NOT has_format_issue THEN step END) OVER (PARTITION BY node_id) AS first_clean FROM trials
    WINDOW w AS (PARTITION BY node_id ORDER BY step)),
q AS (SELECT *, clean AND step > first_clean AND lag(clean) OVER (PARTITION BY node_id ORDER BY step)
        AND lag(step) OVER (PARTITION BY node_id ORDER BY step) > first_clean AS goes FROM o),
z AS (SELECT *, min(CASE WHEN goes THEN step END) OVER (PARTITION BY node_id) AS strict_step FROM q),
st AS (SELECT node_id, step, CASE WHEN step >= strict_step THEN 'STRICT' WHEN step >= first_clean THEN 'RECALL' ELSE 'FORMAT' END AS stage FROM z)
SELECT node_id, step, coalesce(lag(stage) OVER (PARTITION BY node_id ORDER BY step), 'FORMAT') AS stage_before, stage FROM st""",
)
def stage_progress(spark, folder):
    return H.stage_progress(trials(spark, folder), "node_id")


@query(
    "loop_stop",
    f"""{TRIALS_SQL}, c AS (
  SELECT node_id, step + 1 AS cycle, actions % 2 AS patches, round(issues / CAST(n AS DOUBLE), 6) AS failure_rate,
         CASE WHEN n % 4 <> 0 THEN (n % 4) / 4.0 END AS skip_ratio FROM trials
), i AS (SELECT *, sum(CASE WHEN patches > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY cycle) AS island FROM c),
d AS (SELECT *, sum(CASE WHEN patches = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id, island ORDER BY cycle) AS idle FROM i),
r AS (SELECT *, CASE WHEN skip_ratio >= 0.75 THEN 'skip_ratio' WHEN failure_rate <= -1.0 THEN 'target_met'
    WHEN idle >= 3 THEN 'no_patches' WHEN cycle >= 20 THEN 'max_cycles' END AS stop_reason FROM d),
f AS (SELECT *, min(cycle) FILTER (stop_reason IS NOT NULL) OVER (PARTITION BY node_id) AS first FROM r)
SELECT node_id, cycle, patches, failure_rate, stop_reason FROM f WHERE first IS NULL OR cycle <= first""",
)
def loop_stop(spark, folder):
    n = F.col("n")
    cycles = trials(spark, folder).select(
        "node_id",
        (F.col("step") + 1).alias("cycle"),
        (F.col("actions") % 2).alias("patches"),
        F.round(F.col("issues") / n, 6).alias("failure_rate"),
        F.when(n % 4 != 0, (n % 4) / 4.0).alias("skip_ratio"),
    )
    stopped = H.loop_stop(cycles, "node_id", no_patch_rounds=3, target_failure_rate=-1.0, exit_ratio=0.75, max_cycles=20)
    return stopped.select("node_id", "cycle", "patches", "failure_rate", "stop_reason")


SLOTS_SQL = """WITH t AS (
  SELECT user_id AS node_id, event_type AS slot, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step,
         count(*) % 3 = 0 AS accepted FROM events GROUP BY 1, 2, 3
)"""


def slot_trials(spark, folder):
    step = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    grouped = table(spark, folder, "events").groupBy(F.col("user_id").alias("node_id"), F.col("event_type").alias("slot"), step.alias("step"))
    return grouped.agg((F.count(F.lit(1)) % 3 == 0).alias("accepted"))


@query(
    "slot_freeze",
    f"""{SLOTS_SQL}, a AS (SELECT *, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER w AS acc FROM t
  WINDOW w AS (PARTITION BY node_id, slot ORDER BY step)),
g AS (SELECT *, sum(CASE WHEN accepted THEN 0 ELSE 1 END) OVER (PARTITION BY node_id, slot, acc ORDER BY step) AS no_gain FROM a),
s AS (SELECT *, CASE WHEN accepted THEN -1 WHEN acc > 0 AND no_gain >= 2 THEN step + 1 WHEN acc = 0 AND no_gain >= 3 THEN step + 2 END AS setting FROM g)
SELECT node_id, slot, step, CAST(no_gain AS BIGINT) AS no_gain,
  coalesce(last_value(setting IGNORE NULLS) OVER (PARTITION BY node_id, slot ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS frozen_until
FROM s""",
)
def slot_freeze(spark, folder):
    return H.slot_freeze(slot_trials(spark, folder), ["node_id", "slot"]).select("node_id", "slot", "step", "no_gain", "frozen_until")


@query(
    "block_freeze",
    f"""{SLOTS_SQL}, blocks AS (SELECT DISTINCT node_id, slot AS block_id, length(slot) AS block_no,
    CASE WHEN slot = 'view' THEN 'output' ELSE 'instruction' END AS kind FROM t),
past AS (SELECT * FROM t WHERE step < 12),
gain AS (SELECT node_id, slot, max(step) FILTER (accepted) AS g FROM past GROUP BY 1, 2),
st AS (SELECT b.node_id, b.block_id, b.block_no, coalesce(max(g), -1) AS last_improved, b.kind,
    count(*) FILTER (NOT p.accepted AND p.step > coalesce(g, -1)) AS fail_count
  FROM blocks b LEFT JOIN past p ON p.node_id = b.node_id AND p.slot = b.block_id LEFT JOIN gain ON gain.node_id = b.node_id AND gain.slot = b.block_id
  GROUP BY ALL),
fr AS (SELECT *, kind = 'output' OR fail_count >= 3 OR (last_improved >= 0 AND 12 - last_improved >= 3) AS frozen FROM (
  SELECT node_id, block_id, block_no, kind, last_improved, fail_count FROM st)),
pr AS (SELECT *, CASE WHEN frozen THEN NULL WHEN last_improved = 11 THEN 2 WHEN fail_count > 0 THEN -1 ELSE 0 END AS priority FROM fr),
tp AS (SELECT *, coalesce(priority = max(priority) OVER (PARTITION BY node_id), false) AS top FROM pr),
nn AS (SELECT *, row_number() OVER (PARTITION BY node_id, top ORDER BY block_no, block_id) - 1 AS turn, count(*) OVER (PARTITION BY node_id, top) AS tops FROM tp)
SELECT node_id, block_id, last_improved, fail_count, frozen, priority, top AND turn = 12 % tops AS chosen FROM nn""",
)
def block_freeze(spark, folder):
    slots = slot_trials(spark, folder)
    blocks = slots.select("node_id", F.col("slot").alias("block_id")).distinct().select(
        "node_id", "block_id", F.struct(F.length("block_id"), F.col("block_id")).alias("block_no"),
        F.when(F.col("block_id") == "view", "output").otherwise("instruction").alias("kind"),
    )
    tried = slots.select("node_id", F.col("slot").alias("block_id"), "step", F.col("accepted").alias("improved"))
    state = H.block_freeze(blocks, tried, ["node_id"], 12)
    return state.select("node_id", "block_id", "last_improved", "fail_count", "frozen", "priority", "chosen")


@query(
    "is_improved",
    f"""{TRIALS_SQL}, b AS (SELECT node_id, arg_min(score, step) AS base_score, arg_min(issues, step) AS base_failed FROM trials GROUP BY 1)
SELECT node_id, step, (base_failed > 0 AND issues <= base_failed - 1)
  OR score / 100 >= base_score / 100 + CASE WHEN n <= 3 THEN 0.01 ELSE 0.02 END AS improved FROM trials JOIN b USING (node_id)""",
)
def is_improved(spark, folder):
    tried = trials(spark, folder)
    base = tried.groupBy("node_id").agg(F.min_by("score", "step").alias("base_score"), F.min_by("issues", "step").alias("base_failed"))
    better = H.is_improved(F.col("score") / 100, F.col("issues"), F.col("base_score") / 100, F.col("base_failed"), F.col("n"))
    return tried.join(base, "node_id").select("node_id", "step", better.alias("improved"))


@query(
    "best_result",
    f"{TRIALS_SQL} SELECT node_id, arg_min(step, (-score, step)) AS step, CAST(max(score) AS DOUBLE) AS score FROM trials GROUP BY 1",
)
def best_result(spark, folder):
    return H.best_result(trials(spark, folder).select("node_id", "step", "score"), "node_id")


@query(
    "eval_subset",
    """WITH r AS (SELECT user_id AS node_id, event_id AS run_index, event_type <> 'error' AS passed FROM events),
n AS (SELECT node_id, count(*) AS a, count(*) FILTER (NOT passed) AS f FROM r GROUP BY 1),
k AS (SELECT r.*, a, f, row_number() OVER (PARTITION BY node_id, passed ORDER BY md5('3:' || run_index), run_index) AS rn FROM r JOIN n USING (node_id))
SELECT node_id, run_index, passed FROM k
WHERE a < 8 OR f = 0 OR NOT passed OR (f BETWEEN 1 AND 2 AND a - f >= 2 AND rn <= 3)""",
)
def eval_subset(spark, folder):
    records = table(spark, folder, "events").select(
        F.col("user_id").alias("node_id"), F.col("event_id").alias("run_index"), (F.col("event_type") != "error").alias("passed")
    )
    return H.eval_subset(records, ["node_id"], seed=3, minimum=H.EVAL_MINIMUM)

"""Queries over issues and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import actions as AC
from runloom.operators import evidence as E
from runloom.operators import issues as I
from runloom.operators import texts as X
from runloom.plans.registry import query
from runloom.plans.texts import JUDGED_SQL, judge_answers
from runloom.session import checkpointed
from runloom.sources import adapters as A
from runloom.sources.adapters import SPECS_SQL, TEXT_RUNS_SQL, table

BASE = f"WITH {SPECS_SQL}, {TEXT_RUNS_SQL}"
CONS_SQL = """cons AS (SELECT workflow_id, unnest(['the ', 'Return JSON', 'zq' || item_id]) AS c, unnest([0, 1, 2]) AS no FROM specs)"""
RATE_SQL = """rate AS (SELECT workflow_id, avg(CASE WHEN status = 'success' THEN 0.0 ELSE 1.0 END) AS r FROM samples GROUP BY 1)"""
INSUFFICIENT_SQL = """SELECT workflow_id, 'insufficient_data' AS kind, 'low' AS severity, 'No execution samples available' AS message, CAST(NULL AS BIGINT) AS evidence_run
FROM specs WHERE workflow_id NOT IN (SELECT workflow_id FROM samples)"""
FAILURE_SQL = """SELECT s.workflow_id, 'high_failure_rate' AS kind, 'high' AS severity,
  printf('Failure rate %.2f exceeds threshold %.2f', r, coalesce(max_failure_rate, 0.2)) AS message, s."index" AS evidence_run
FROM samples s JOIN rate USING (workflow_id) LEFT JOIN specs USING (workflow_id) WHERE r > coalesce(max_failure_rate, 0.2) AND s.status <> 'success'"""
MISSING_SQL = """SELECT s.workflow_id, 'constraint_missing' AS kind, 'high' AS severity, 'Constraint not observed in outputs: ' || c AS message, s."index" AS evidence_run
FROM samples s JOIN (SELECT workflow_id, c FROM cons JOIN samples USING (workflow_id) GROUP BY 1, 2 HAVING NOT bool_or(contains(lower(output_text), lower(c)))) m USING (workflow_id)"""
LATENCY_SQL = """SELECT s.workflow_id, 'latency_exceeded' AS kind, 'medium' AS severity,
  printf('Latency exceeded %.1fs in %d runs', max_latency_seconds, count(*) OVER (PARTITION BY s.workflow_id)) AS message, s."index" AS evidence_run
FROM samples s JOIN specs USING (workflow_id) WHERE duration_seconds > max_latency_seconds"""
SHOWN = ("workflow_id", "kind", "severity", "message", "evidence_run")


def inputs(spark, folder):
    return A.text_runs(spark, folder), A.reference_specs(spark, folder)


def judged(spark, folder):
    return X.parse_judge_verdict(judge_answers(spark, folder), "raw")


@query("issue_insufficient_data", f"{BASE} {INSUFFICIENT_SQL}")
def issue_insufficient_data(spark, folder):
    samples, specs = inputs(spark, folder)
    return I.issue_insufficient_data(specs, samples).select(*SHOWN)


@query("issue_high_failure_rate", f"{BASE}, {RATE_SQL} {FAILURE_SQL}")
def issue_high_failure_rate(spark, folder):
    return I.issue_high_failure_rate(*inputs(spark, folder)).select(*SHOWN)


@query("issue_low_similarity")
def issue_low_similarity(spark, folder):
    return I.issue_low_similarity(*inputs(spark, folder)).select(*SHOWN)


@query("issue_constraint_missing", f"{BASE}, {CONS_SQL} {MISSING_SQL}")
def issue_constraint_missing(spark, folder):
    return I.issue_constraint_missing(*inputs(spark, folder)).select(*SHOWN)


@query("issue_latency_exceeded", f"{BASE} {LATENCY_SQL}")
def issue_latency_exceeded(spark, folder):
    return I.issue_latency_exceeded(*inputs(spark, folder)).select(*SHOWN)


MISMATCH_SQL = """SELECT workflow_id, 'llm_output_mismatch' AS kind, severity,
  'LLM judge flagged mismatch: ' || reason || ' | missing_items=' || missing || ' | incorrect_items=' || incorrect
    || ' | format_ok=' || CASE WHEN format_ok THEN 'True' ELSE 'False' END AS message, doc_id AS evidence_run
FROM judged WHERE NOT passed"""


@query("issue_output_mismatch", f"WITH {JUDGED_SQL} {MISMATCH_SQL}")
def issue_output_mismatch(spark, folder):
    return I.issue_output_mismatch(judged(spark, folder)).select(*SHOWN)


@query(
    "issue_judge_unreliable",
    f"""{BASE}, broken AS (SELECT DISTINCT workflow_id FROM samples WHERE "index" % 50 = 7),
bad AS (SELECT DISTINCT workflow_id FROM samples WHERE "index" % 60 = 11)
SELECT workflow_id, 'llm_judge_unreliable' AS kind, 'medium' AS severity, 'judge failed or unavailable, reference check incomplete' AS message, "index" AS evidence_run
FROM samples WHERE workflow_id IN (SELECT workflow_id FROM broken) AND workflow_id NOT IN (SELECT workflow_id FROM bad)""",
)
def issue_judge_unreliable(spark, folder):
    samples, _ = inputs(spark, folder)
    # some calls of the judge failed, a few answers report a mismatch
    answer = F.when(F.col("index") % 60 == 11, '{"verdict":"fail"}').when(F.col("index") % 50 != 7, '{"verdict":"pass"}')
    calls = samples.select("workflow_id", "index", answer.alias("raw"))
    verdicts = X.parse_judge_verdict(calls, "raw")
    return I.issue_judge_unreliable(samples, verdicts, calls).select(*SHOWN)


@query("detect_issues")
def detect_issues(spark, folder):
    samples, specs = inputs(spark, folder)
    return I.detect_issues(samples, specs, judged(spark, folder)).select(*SHOWN)


@query("analyze_single_output")
def analyze_single_output(spark, folder):
    samples, specs = inputs(spark, folder)
    trials = samples.withColumn("trial_id", F.concat(F.lit("t"), F.col("index").cast("string")))
    return I.analyze_single_output(trials, specs).select("trial_id", "kind", "severity", "message")


def native_issues(spark, folder):
    """The issues that need no text similarity, judge answers included."""
    samples, specs = inputs(spark, folder)
    parts = I.issue_high_failure_rate(samples, specs).unionByName(I.issue_constraint_missing(samples, specs))
    return parts.unionByName(I.issue_latency_exceeded(samples, specs)).unionByName(
        I.issue_output_mismatch(judged(spark, folder))
    ), specs


ISSUES_SQL = f"""{BASE}, {CONS_SQL}, {RATE_SQL}, {JUDGED_SQL}, issues AS (
  {FAILURE_SQL} UNION ALL {MISSING_SQL} UNION ALL {LATENCY_SQL} UNION ALL {MISMATCH_SQL})"""


@query(
    "fail_signal",
    f"""{ISSUES_SQL}, m AS (SELECT DISTINCT workflow_id, kind, message, lower(message) AS low FROM issues),
sig AS (
  SELECT DISTINCT workflow_id, 'tags' AS bucket, kind AS item FROM m
  UNION SELECT workflow_id, 'missing_fields', message FROM m WHERE contains(low, 'missing') OR contains(low, 'not observed')
  UNION SELECT workflow_id, 'format_errors', message FROM m WHERE contains(low, 'format') OR contains(low, 'json')
  UNION SELECT workflow_id, 'constraint_gaps', message FROM m WHERE contains(low, 'constraint')
  UNION SELECT workflow_id, 'semantic_gaps', message FROM m WHERE contains(low, 'similarity') OR contains(low, 'mismatch')
)
SELECT * FROM sig UNION ALL
SELECT workflow_id, 'constraint_gaps', 'Ensure constraint is satisfied: ' || c FROM cons
WHERE workflow_id IN (SELECT workflow_id FROM m) AND NOT EXISTS (
  SELECT 1 FROM sig WHERE sig.workflow_id = cons.workflow_id AND sig.bucket = 'constraint_gaps' AND contains(lower(sig.item), lower(cons.c)))""",
)
def fail_signal(spark, folder):
    issues, specs = native_issues(spark, folder)
    return I.fail_signal(checkpointed(issues), specs).select("workflow_id", "bucket", "item")


# Per judge shape: 1 names a missing item, 2 two incorrect items and a bad format, 4 and 5 a bad format.
MAPPED_SQL = f"""{ISSUES_SQL}, raw AS (
  SELECT workflow_id, 'add_global_constraint' AS type, substr(message, 36 + 1) AS target, substr(message, 36 + 1) AS content, evidence_run
    FROM issues WHERE kind = 'constraint_missing'
  UNION ALL SELECT workflow_id, 'add_checkpoint_rule', 'date', 'Must include: date', doc_id FROM judged WHERE doc_id % 6 = 1
  UNION ALL SELECT workflow_id, 'add_global_constraint', 'Avoid: x', 'Avoid: x', doc_id FROM judged WHERE doc_id % 6 = 2
  UNION ALL SELECT j.workflow_id, 'add_global_constraint', 'Avoid: ' || lang, 'Avoid: ' || lang, doc_id FROM judged j JOIN documents USING (doc_id) WHERE doc_id % 6 = 2
  UNION ALL SELECT workflow_id, 'tighten_schema', NULL, 'Ensure output strictly matches JSON schema.', doc_id FROM judged WHERE doc_id % 6 IN (2, 4, 5)
)"""


@query(
    "actions_from_issues",
    # of the judge's single-run actions constraints keep the first run, schemas and rules the last one
    MAPPED_SQL + """, one AS (
  SELECT workflow_id, type, target, content, CASE WHEN type = 'add_global_constraint' THEN min(evidence_run) ELSE max(evidence_run) END AS evidence_run
  FROM raw WHERE NOT (type = 'add_global_constraint' AND content NOT LIKE 'Avoid: %') GROUP BY 1, 2, 3, 4)
SELECT workflow_id, type, target, trim(content) AS content, evidence_run FROM one
UNION ALL SELECT workflow_id, type, trim(target), trim(content), evidence_run FROM raw WHERE type = 'add_global_constraint' AND content NOT LIKE 'Avoid: %'""",
)
def actions_from_issues(spark, folder):
    issues, specs = native_issues(spark, folder)
    return AC.actions_from_issues(checkpointed(issues), specs).select("workflow_id", "type", "target", "content", "evidence_run")


@query(
    "actions_from_signal",
    f"""{BASE}, {CONS_SQL}, {RATE_SQL}, issues AS ({FAILURE_SQL} UNION ALL {LATENCY_SQL})
SELECT workflow_id, 'add_global_constraint' AS type, CAST(NULL AS VARCHAR) AS target, 'Ensure constraint is satisfied: ' || c AS content, evidence_run
FROM cons JOIN (SELECT DISTINCT workflow_id, evidence_run FROM issues) e USING (workflow_id)""",
)
def actions_from_signal(spark, folder):
    samples, specs = inputs(spark, folder)
    issues = I.issue_high_failure_rate(samples, specs).unionByName(I.issue_latency_exceeded(samples, specs))
    return AC.actions_from_signal(checkpointed(issues), specs).select("workflow_id", "type", "target", "content", "evidence_run")


def native_heads(spark, folder):
    """Heads of the issues that need no text similarity, their sets and the references."""
    samples, specs = inputs(spark, folder)
    answer = F.when(F.col("index") % 60 == 11, '{"verdict":"fail"}').when(F.col("index") % 50 != 7, '{"verdict":"pass"}')
    calls = samples.select("workflow_id", "index", answer.alias("raw"))
    unreliable = I.judge_unreliable_heads(X.parse_judge_verdict(calls, "raw"), calls)
    heads = checkpointed(I.detect_heads(samples, specs, judged(spark, folder), similarity=False).unionByName(unreliable))
    return heads, I.evidence_sets(samples, specs, heads), specs


HEADS_SQL = f"""{BASE}, {CONS_SQL}, {RATE_SQL}, {JUDGED_SQL},
broken AS (SELECT DISTINCT workflow_id FROM samples WHERE "index" % 50 = 7), bad AS (SELECT DISTINCT workflow_id FROM samples WHERE "index" % 60 = 11),
issues AS ({INSUFFICIENT_SQL} UNION ALL {FAILURE_SQL} UNION ALL {MISSING_SQL} UNION ALL {LATENCY_SQL} UNION ALL {MISMATCH_SQL}
  UNION ALL SELECT workflow_id, 'llm_judge_unreliable', 'medium', 'judge failed or unavailable, reference check incomplete', "index"
  FROM samples WHERE workflow_id IN (SELECT workflow_id FROM broken) AND workflow_id NOT IN (SELECT workflow_id FROM bad))"""


@query(
    "issue_evidence",
    HEADS_SQL + """ SELECT workflow_id, kind, severity, message, count(evidence_run) AS evidence_count, min(evidence_run) AS first_run FROM issues
WHERE kind <> 'llm_output_mismatch' GROUP BY 1, 2, 3, 4
UNION ALL SELECT workflow_id, kind, severity, message, 1, evidence_run FROM issues WHERE kind = 'llm_output_mismatch'""",
)
def issue_evidence(spark, folder):
    """Every issue in one row, with the number of its runs and the first of them, from shared bitmaps."""
    heads, sets, _ = native_heads(spark, folder)
    counted = I.with_evidence_count(heads, sets)
    firsts = E.runs(sets, ["workflow_id", "evidence_set"]).groupBy("workflow_id", "evidence_set").agg(F.min("evidence_run").alias("_first"))
    found = counted.join(firsts, ["workflow_id", "evidence_set"], "left")
    return found.select("workflow_id", "kind", "severity", "message", "evidence_count", F.coalesce("evidence_run", "_first").alias("first_run"))


@query(
    "signal_evidence",
    f"""{BASE}, {CONS_SQL}, {RATE_SQL}, issues AS ({FAILURE_SQL} UNION ALL {LATENCY_SQL})
SELECT workflow_id, 'add_global_constraint' AS type, CAST(NULL AS VARCHAR) AS target, 'Ensure constraint is satisfied: ' || c AS content, n AS evidence_count
FROM cons JOIN (SELECT workflow_id, count(DISTINCT evidence_run) AS n FROM issues GROUP BY 1) e USING (workflow_id)""",
)
def signal_evidence(spark, folder):
    """Actions from signals, one row each: all actions of a workflow share one set of runs."""
    samples, specs = inputs(spark, folder)
    heads = checkpointed(I.failure_rate_heads(samples, specs).unionByName(I.latency_heads(samples, specs)))
    actions, sets = AC.signal_heads(heads, I.evidence_sets(samples, specs, heads), specs)
    return AC.with_evidence_count(actions, sets).select("workflow_id", "type", "target", "content", "evidence_count")


@query(
    "issue_actions",
    MAPPED_SQL + """, one AS (
  SELECT workflow_id, type, target, trim(content) AS content, 1 AS evidence_count FROM raw
  WHERE NOT (type = 'add_global_constraint' AND content NOT LIKE 'Avoid: %') GROUP BY 1, 2, 3, 4)
SELECT * FROM one UNION ALL SELECT workflow_id, type, trim(target), trim(content), count(DISTINCT evidence_run) FROM raw
WHERE type = 'add_global_constraint' AND content NOT LIKE 'Avoid: %' GROUP BY 1, 2, 3, 4""",
)
def issue_actions(spark, folder):
    """Actions of all issues, one row each with the number of runs behind it."""
    samples, specs = inputs(spark, folder)
    branches = I.failure_rate_heads(samples, specs).unionByName(I.constraint_missing_heads(samples, specs))
    heads = checkpointed(branches.unionByName(I.latency_heads(samples, specs)).unionByName(I.output_mismatch_heads(judged(spark, folder))))
    actions, _ = AC.head_actions(heads, I.evidence_sets(samples, specs, heads), specs)
    return actions.select("workflow_id", "type", "target", "content", "evidence_count")


# Sample actions from order lines: node = order, evidence = supplier, text of varying length.
LINES_SQL = """WITH l AS (
  SELECT DISTINCT l_orderkey % 500 AS node_id, l_partkey AS seq,
    CASE l_partkey % 5 WHEN 0 THEN 'Add_Checkpoint_Rule' WHEN 1 THEN 'add_global_constraint' WHEN 2 THEN 'tighten_schema' WHEN 3 THEN 'increase_strictness' ELSE 'rewrite' END AS type,
    CASE WHEN l_partkey % 4 <> 0 THEN ' t' || (l_partkey % 3) END AS target,
    repeat('c', CAST(l_partkey % 6 AS BIGINT)) || (l_partkey % 2) AS content, l_suppkey AS evidence_run
  FROM lineitem
), acts AS (SELECT node_id, seq, lower(type) AS type, trim(target) AS target, content, evidence_run FROM l)"""


def line_actions(spark, folder):
    key = F.col("l_partkey")
    kinds = F.array(*map(F.lit, ("Add_Checkpoint_Rule", "add_global_constraint", "tighten_schema", "increase_strictness", "rewrite")))
    return (
        table(spark, folder, "lineitem")
        .select(
            (F.col("l_orderkey") % 500).alias("node_id"),
            key.alias("seq"),
            F.element_at(kinds, (key % 5 + 1).cast("int")).alias("type"),
            F.when(key % 4 != 0, F.concat(F.lit(" t"), (key % 3).cast("string"))).alias("target"),
            F.concat(F.expr("repeat('c', cast(l_partkey % 6 as int))"), (key % 2).cast("string")).alias("content"),
            F.col("l_suppkey").alias("evidence_run"),
        )
        .distinct()
    )


@query(
    "normalize_actions",
    LINES_SQL + """, h AS (
  SELECT node_id, seq, type, CASE WHEN target IS NOT NULL THEN target WHEN type = 'add_global_constraint' THEN content
    WHEN type = 'add_checkpoint_rule' THEN 'generic' END AS target, content, count(DISTINCT evidence_run) AS n FROM acts GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY node_id, type, target ORDER BY
    CASE WHEN type IN ('add_checkpoint_rule', 'increase_strictness') THEN -n ELSE 0 END,
    CASE WHEN type IN ('add_checkpoint_rule', 'increase_strictness', 'tighten_schema') THEN -seq ELSE seq END) AS rk,
    min(seq) OVER (PARTITION BY node_id, type, target) AS pos FROM h),
w AS (SELECT *, row_number() OVER (PARTITION BY node_id, type, CASE WHEN type = 'add_global_constraint' THEN content ELSE '' || seq END ORDER BY pos) AS dup FROM r WHERE rk = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, type, coalesce(target, ''), content, pos) AS b FROM w WHERE dup = 1)
SELECT node_id, pos AS seq, type, target, content, n AS evidence_count FROM f WHERE b <= 5""",
)
def normalize_actions(spark, folder):
    return AC.normalize_heads(line_actions(spark, folder), "node_id", budget=5).select("node_id", "seq", "type", "target", "content", "evidence_count")


@query(
    "merge_actions",
    LINES_SQL + """, o AS (
  SELECT node_id, type, target, min(seq) AS seq, arg_min(content, (-length(content), seq)) AS content, count(DISTINCT evidence_run) AS evidence_count
  FROM acts WHERE type <> 'add_global_constraint' GROUP BY 1, 2, 3
), g AS (SELECT node_id, content, min(seq) AS seq FROM acts WHERE type = 'add_global_constraint' GROUP BY 1, 2)
SELECT node_id, seq, type, target, content, evidence_count FROM o
UNION ALL SELECT g.node_id, g.seq, 'add_global_constraint', max(a.target), g.content, count(DISTINCT a.evidence_run)
FROM g JOIN acts a ON a.node_id = g.node_id AND a.seq = g.seq GROUP BY 1, 2, 5""",
)
def merge_actions(spark, folder):
    heads, _ = AC.merge_heads(line_actions(spark, folder), "node_id")
    return heads.select("node_id", "seq", "type", "target", "content", "evidence_count")


@query(
    "stage_filter",
    LINES_SQL + """ SELECT DISTINCT node_id, seq, type FROM acts WHERE CASE node_id % 3
  WHEN 0 THEN type IN ('tighten_schema', 'add_global_constraint') WHEN 1 THEN type <> 'increase_strictness' ELSE true END""",
)
def stage_filter(spark, folder):
    stages = F.array(F.lit("FORMAT"), F.lit("RECALL"), F.lit("STRICT"))
    stage = F.element_at(stages, (F.col("node_id") % 3 + 1).cast("int"))
    lowered = line_actions(spark, folder).withColumn("type", F.lower("type"))
    return AC.stage_filter(lowered, stage).select("node_id", "seq", "type").distinct()

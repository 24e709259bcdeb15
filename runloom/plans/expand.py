"""Queries over plans: parameters, cases, manifests, tasks and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import expand as X
from runloom.plans.registry import query
from runloom.sources import adapters as A
from runloom.sources.adapters import PLAN_SQL, RUNS_SQL, table


def shown(parameters):
    """Case parameters as ``key=value`` text, in parameter order."""
    entries = F.transform(
        F.map_entries(parameters), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    return F.array_join(entries, ";").alias("parameters")


def dims(spark, folder):
    return X.dimensions(A.datasets(spark, folder).select("dataset"), A.parameters(spark, folder))


FIRST_SQL = "max(v) FILTER (pos = 0)"
SCENARIO_SQL = f"""
firsts AS (
  SELECT ds.dataset, p.param, p.ordinal, {FIRST_SQL} AS v
  FROM ds CROSS JOIN (VALUES (0, 'tone'), (1, 'length'), (2, 'lang'), (3, 'temperature'), (4, 'topic')) p(ordinal, param)
  LEFT JOIN dim ON dim.dataset = ds.dataset AND dim.param = p.param GROUP BY ALL
),
scenario AS (
  SELECT dataset, 0 AS case_no, string_agg(param || '=' || coalesce(v, 'null'), ';' ORDER BY ordinal) AS parameters
  FROM firsts GROUP BY dataset
)"""
CARTESIAN_SQL = """
product AS (
  SELECT t.dataset, t.pos AS i0, l.pos AS i1, g.pos AS i2, p.pos AS i4,
         'tone=' || t.v || ';length=' || l.v || ';lang=' || g.v || ';temperature=0.7;topic=' || p.v AS parameters
  FROM dim t JOIN dim l ON l.dataset = t.dataset AND l.ordinal = 1 JOIN dim g ON g.dataset = t.dataset AND g.ordinal = 2
  JOIN dim p ON p.dataset = t.dataset AND p.ordinal = 4 WHERE t.ordinal = 0
),
cartesian AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY i0, i1, i2, i4) - 1 AS case_no, parameters FROM product)"""
# Rows of the covering array per dataset, written out independently of the DataFrame version.
PAIRWISE_SQL = """
pdim AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY ordinal) - 1 AS c FROM dim WHERE ordinal <> 3),
lev AS (SELECT dataset, c, param, ordinal, count(*) AS n FROM pdim GROUP BY ALL),
primes AS (SELECT x FROM range(2, 60) a(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 60) b(y) WHERE y < x AND x % y = 0)),
need AS (SELECT dataset, greatest(max(n), count(*) - 1, 2) AS least FROM lev GROUP BY dataset),
shape AS (SELECT dataset, min(x) AS p FROM need JOIN primes ON x >= least GROUP BY dataset),
oa AS (
  SELECT s.dataset, i * p + j AS case_no, l.c, l.param, l.ordinal,
         CASE WHEN l.c = 0 THEN i % n ELSE ((i * (l.c - 1) + j) % p) % n END AS cell
  FROM shape s JOIN lev l ON l.dataset = s.dataset, range(0, 60) a(i), range(0, 60) b(j) WHERE i < p AND j < p
),
firstcover AS (
  SELECT DISTINCT dataset, case_no FROM (
    SELECT a.dataset, min(a.case_no) AS case_no FROM oa a JOIN oa b ON a.dataset = b.dataset AND a.case_no = b.case_no AND a.c < b.c
    GROUP BY a.dataset, a.c, b.c, a.cell, b.cell)
),
pairwise AS (
  SELECT oa.dataset, oa.case_no, string_agg(oa.param || '=' || pdim.v, ';' ORDER BY oa.ordinal) AS parameters
  FROM oa JOIN firstcover USING (dataset, case_no) JOIN pdim ON pdim.dataset = oa.dataset AND pdim.c = oa.c AND pdim.pos = oa.cell
  GROUP BY oa.dataset, oa.case_no
)"""


@query(
    "broadcast_inputs",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey, 1 + o_custkey % 4 AS n,
    CASE WHEN o_custkey % 5 = 0 THEN 2 + o_custkey % 4 ELSE 1 + o_custkey % 4 END AS m FROM orders)
SELECT 'order_' || o_orderkey AS workflow_id, i AS "index", 'a' || i AS a, o_orderstatus AS b, 'c' || i AS c
FROM o, range(1, 6) r(i) WHERE i <= n AND n = m""",
)
def broadcast_inputs(spark, folder):
    n = (1 + F.col("o_custkey") % 4).cast("int")
    m = F.when(F.col("o_custkey") % 5 == 0, n + 1).otherwise(n)

    def listed(name, size):
        values = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit(name), i.cast("string")))
        return F.struct(F.lit(name).alias("name"), F.lit(True).alias("is_list"), values.alias("values"))

    scalar = F.struct(F.lit("b").alias("name"), F.lit(False).alias("is_list"), F.array("o_orderstatus").alias("values"))
    inputs = table(spark, folder, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("workflow_id"),
        F.inline(F.array(listed("a", n), scalar, listed("c", m))),
    )
    rows = X.broadcast_inputs(inputs)
    return rows.select("workflow_id", "index", *[F.col("inputs")[k].alias(k) for k in "abc"])


@query(
    "align_references",
    f"""WITH {RUNS_SQL}, placed AS (
  SELECT workflow_id, execution_id, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, seq) AS "index" FROM runs
), n AS (SELECT count(*) AS n FROM benchmark)
SELECT workflow_id, p."index", execution_id,
  CASE WHEN workflow_id = 'wf_0' THEN (SELECT text FROM benchmark WHERE item_id = 0)
       WHEN p."index" % 5 <> 0 THEN b.text END AS reference_text
FROM placed p CROSS JOIN n LEFT JOIN benchmark b ON b.item_id + 1 = p."index"
WHERE workflow_id = 'wf_0' OR p."index" <= n.n""",
)
def align_references(spark, folder):
    return X.align_references(*run_references(spark, folder)).select("workflow_id", "index", "execution_id", "reference_text")


@query(
    "align_references_rejects",
    f"""WITH {RUNS_SQL}, placed AS (
  SELECT workflow_id, execution_id, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, seq) AS "index" FROM runs
), n AS (SELECT count(*) AS n FROM benchmark), l AS (
SELECT workflow_id, "index", execution_id, CASE WHEN workflow_id = 'wf_9' THEN 'workflow has no reference' WHEN workflow_id = 'wf_0' THEN NULL
  WHEN "index" > n THEN 'beyond the last reference' WHEN "index" % 5 = 0 THEN 'reference is missing' END AS reason FROM placed, n)
SELECT * FROM l WHERE reason IS NOT NULL""",
)
def align_references_rejects(spark, folder):
    """Runs that no reference text serves, and why; wf_9 has no reference at all."""
    placed, references = run_references(spark, folder)
    labelled = X.labelled_alignment(placed, references.where("workflow_id <> 'wf_9'"))
    return labelled.where("reason is not null").select("workflow_id", "index", "execution_id", "reason")


def run_references(spark, folder):
    """Numbered runs and the references of their workflows."""
    facts = A.runs(spark, folder).select("workflow_id", "execution_id", "ts", "seq")
    placed = X.run_index(facts, ["workflow_id"], ["ts", "seq"]).withColumnRenamed("run_index", "index")
    workflows = facts.select("workflow_id").distinct()
    items = table(spark, folder, "benchmark").select((F.col("item_id") + 1).alias("index"), "text")
    # wf_0 has a single reference, the others one per item with every fifth one missing
    single = items.where(F.col("index") == 1).select(F.lit("wf_0").alias("workflow_id"), "index", F.col("text").alias("reference_text"))
    others = F.array(*[F.lit(f"wf_{i}") for i in range(1, 10)])
    many = items.select(
        F.explode(others).alias("workflow_id"), "index", F.when(F.col("index") % 5 != 0, F.col("text")).alias("reference_text")
    ).join(workflows, "workflow_id", "left_semi")
    return placed, single.unionByName(many)


@query("plan_dataset_join", f"WITH {PLAN_SQL} SELECT catalog_id, ref_order, dataset FROM refs JOIN ds USING (dataset)")
def plan_dataset_join(spark, folder):
    return X.plan_dataset_join(A.plan(spark, folder), A.datasets(spark, folder)).select("catalog_id", "ref_order", "dataset")


@query(
    "variant_dataset_cross",
    f"""WITH {PLAN_SQL} SELECT refs.catalog_id, ref_order, dataset, variant_id
FROM refs JOIN ds USING (dataset) JOIN vars USING (catalog_id)""",
)
def variant_dataset_cross(spark, folder):
    crossed = X.variant_dataset_cross(A.plan(spark, folder), A.datasets(spark, folder))
    return crossed.select("catalog_id", "ref_order", "dataset", "variant_id")


@query("expand_parameter", f"WITH {PLAN_SQL} SELECT dataset, param, pos, v FROM dim")
def expand_parameter(spark, folder):
    values = X.expand_parameter(*[F.col(c) for c in ("values", "min", "max", "step", "default")])
    return A.parameters(spark, folder).select("dataset", "param", F.posexplode(values).alias("pos", "v"))


@query("cases_scenario_only", f"WITH {PLAN_SQL}, {SCENARIO_SQL} SELECT * FROM scenario")
def cases_scenario_only(spark, folder):
    return X.cases_scenario_only(dims(spark, folder)).select("dataset", "case_no", shown(F.col("parameters")))


@query("cases_cartesian", f"WITH {PLAN_SQL}, {CARTESIAN_SQL} SELECT * FROM cartesian WHERE case_no < 50")
def cases_cartesian(spark, folder):
    return X.cases_cartesian(dims(spark, folder), 50).select("dataset", "case_no", shown(F.col("parameters")))


@query("cases_naive", f"WITH {PLAN_SQL}, {CARTESIAN_SQL} SELECT * FROM cartesian WHERE case_no < 100")
def cases_naive(spark, folder):
    return X.cases_naive(dims(spark, folder), 100).select("dataset", "case_no", shown(F.col("parameters")))


@query("cases_pairwise", f"WITH {PLAN_SQL}, {PAIRWISE_SQL} SELECT * FROM pairwise")
def cases_pairwise(spark, folder):
    made = X.cases_pairwise(X.pairwise_dims(dims(spark, folder)))
    return made.select("dataset", "case_no", shown(F.col("parameters")))


@query(
    "pairwise_coverage",
    f"""WITH {PLAN_SQL}, lev AS (SELECT dataset, ordinal, count(*) AS n FROM dim WHERE ordinal <> 3 GROUP BY ALL)
SELECT a.dataset, CAST(sum(a.n * b.n) AS BIGINT) AS required, CAST(0 AS BIGINT) AS missing
FROM lev a JOIN lev b ON a.dataset = b.dataset AND a.ordinal < b.ordinal GROUP BY a.dataset""",
)
def pairwise_coverage(spark, folder):
    paired = X.pairwise_dims(dims(spark, folder))
    cases = X.cases_pairwise(paired)
    none = cases.select("dataset", "parameters").where(F.lit(False))
    required = X.pairwise_coverage(paired, none).groupBy("dataset").agg(F.count(F.lit(1)).alias("required"))
    missing = X.pairwise_coverage(paired, cases).groupBy("dataset").agg(F.count(F.lit(1)).alias("_missing"))
    return required.join(missing, "dataset", "left").select(
        "dataset", "required", F.coalesce("_missing", F.lit(0).cast("long")).alias("missing")
    )


def wide_dims(spark, folder):
    """Twelve parameters of two to four levels per supplier."""
    key = F.col("s_suppkey")

    def parameter(i):
        top = (1 + (key + i) % 3).cast("int")
        values = F.transform(F.sequence(F.lit(0), top), lambda j: F.concat(F.lit(f"d{i}_"), j.cast("string")))
        return F.struct(
            F.lit(i).alias("ordinal"), F.lit(f"d{i}").alias("param"), F.lit(True).alias("pairwise"), values.alias("values")
        )

    return table(spark, folder, "supplier").select(
        F.concat(F.lit("ds_"), key.cast("string")).alias("dataset"), F.array(*map(parameter, range(12))).alias("dims")
    )


@query(
    "cases_hierarchical",
    f"""WITH ds AS (SELECT s_suppkey AS sk, 'ds_' || s_suppkey AS dataset FROM supplier),
dim AS (SELECT dataset, i AS ordinal, 'd' || i AS param, 'd' || i || '_' || j AS v, j AS pos
        FROM ds, range(0, 5) a(i), range(0, 4) b(j) WHERE j <= 1 + (sk + i) % 3),
{PAIRWISE_SQL.replace('ordinal <> 3', 'true')}
SELECT dataset, case_no, parameters || ';d5=d5_0;d6=d6_0;d7=d7_0;d8=d8_0;d9=d9_0;d10=d10_0;d11=d11_0' AS parameters FROM pairwise""",
)
def cases_hierarchical(spark, folder):
    return X.cases_hierarchical(wide_dims(spark, folder)).select("dataset", "case_no", shown(F.col("parameters")))


@query(
    "limit_cases",
    f"""WITH {PLAN_SQL}, {CARTESIAN_SQL} SELECT dataset, case_no, parameters FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || dataset || ':' || case_no), case_no) AS r FROM cartesian) WHERE r <= 3""",
)
def limit_cases(spark, folder):
    cases = X.cases_cartesian(dims(spark, folder))
    return X.limit_cases(cases, ["dataset"], 3, seed=42).select("dataset", "case_no", shown(F.col("parameters")))


@query(
    "cases_from_flows",
    f"""WITH {PLAN_SQL}, {SCENARIO_SQL} SELECT dataset, flow_no AS case_no, parameters, title AS flow
FROM fl JOIN scenario USING (dataset)""",
)
def cases_from_flows(spark, folder):
    made = X.cases_from_flows(dims(spark, folder), A.flows(spark, folder))
    return made.select("dataset", "case_no", shown(F.col("parameters")), "flow")


def plan_cases(spark, folder, mode="pairwise"):
    return X.generate_cases(
        A.plan(spark, folder), A.datasets(spark, folder), A.parameters(spark, folder), A.flows(spark, folder), mode
    )


CASES_SQL = f"""{PLAN_SQL}, {SCENARIO_SQL}, {PAIRWISE_SQL}, made AS (
  SELECT dataset, case_no, parameters, NULL AS flow FROM pairwise WHERE dataset NOT IN (SELECT dataset FROM fl)
  UNION ALL SELECT dataset, flow_no, parameters, title FROM fl JOIN scenario USING (dataset)
),
cases AS (
  SELECT refs.catalog_id AS workflow_id, dataset, variant_id, case_no, parameters, flow
  FROM refs JOIN vars USING (catalog_id) JOIN made USING (dataset) WHERE enabled
)"""


@query("generate_cases", f"WITH {CASES_SQL} SELECT * FROM cases")
def generate_cases(spark, folder):
    made = plan_cases(spark, folder)
    return made.select("workflow_id", "dataset", "variant_id", "case_no", shown(F.col("parameters")), "flow")


@query(
    "build_manifests",
    f"""WITH {CASES_SQL} SELECT workflow_id, coalesce(variant_id, 'default') AS variant_id, count(*) AS cases,
  coalesce(max(version), 'unknown') AS workflow_version
FROM cases JOIN (SELECT 'flow_' || c_custkey AS workflow_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS version
                 FROM customer) USING (workflow_id) GROUP BY 1, 2""",
)
def build_manifests(spark, folder):
    catalog = table(spark, folder, "customer").select(
        F.concat(F.lit("flow_"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("version"),
    )
    return X.build_manifests(plan_cases(spark, folder), catalog)


@query(
    "build_tasks",
    f"""WITH {CASES_SQL} SELECT
  sha256(workflow_id || '|' || coalesce(variant_id, 'default') || '|' || dataset || '|' || case_no || '|' || replace(parameters, '=null', '=')) AS task_id,
  workflow_id, dataset, 'pending' AS task_status, 30.0 AS timeout_seconds, 2 AS max_retries FROM cases""",
)
def build_tasks(spark, folder):
    made = X.build_tasks(plan_cases(spark, folder), timeout_per_task=30.0)
    return made.select("task_id", "workflow_id", "dataset", "task_status", "timeout_seconds", "max_retries")


@query(
    "apply_variant_patches",
    """WITH n AS (SELECT 'wf_' || source AS workflow_id, 'node_' || doc_id AS node_id, doc_id, lang, text FROM documents)
SELECT workflow_id, 'v1' AS variant_id, node_id,
  CASE WHEN doc_id % 4 = 0 THEN 'by path' WHEN doc_id % 4 = 1 THEN 'first' || chr(10) || text
       WHEN doc_id % 4 = 2 THEN text || chr(10) || 'label ' || lang ELSE 'You are a writer of ' || lang || ' $1.' END AS text
FROM n""",
)
def apply_variant_patches(spark, folder):
    key = F.col("doc_id")
    docs = table(spark, folder, "documents").select(F.concat(F.lit("wf_"), "source").alias("workflow_id"), "doc_id", "lang", "text")
    kind = F.when(key % 4 == 2, "label").when(key % 4 == 3, "plain").otherwise("llm")
    nodes = docs.select(
        "workflow_id", F.concat(F.lit("node_"), key.cast("string")).alias("node_id"), F.concat(F.lit("l_"), "lang").alias("label"),
        kind.alias("type"), F.concat(F.lit("/graph/nodes/"), key.cast("string")).alias("path"), "text",
    )
    none = F.lit(None).cast("string")
    variables = F.create_map(F.lit("role"), F.lit("writer"), F.lit("language"), F.concat("lang", F.lit(" $1")))
    no_vars = F.create_map().cast("map<string,string>")
    by_node = docs.select(
        "workflow_id", F.lit("v1").alias("variant_id"), key.alias("patch_no"),
        F.when(key % 4 == 0, F.concat(F.lit("/graph/nodes/"), key.cast("string"))).alias("by_path"),
        F.when(key % 4 != 2, F.concat(F.lit("node_"), key.cast("string"))).alias("by_id"),
        none.alias("by_label"), none.alias("by_type"),
        F.when(key % 4 == 0, "replace").when(key % 4 == 1, "prepend").otherwise("template").alias("mode"),
        F.when(key % 4 == 0, "by path").when(key % 4 == 1, "first").otherwise("You are a {{ role }} of {{language}}.").alias("content"),
        F.when(key % 4 == 3, variables).otherwise(no_vars).alias("variables"),
    ).where(key % 4 != 2)
    by_label = docs.select("workflow_id", "lang").distinct().select(
        "workflow_id", F.lit("v1").alias("variant_id"), F.lit(-1).cast("long").alias("patch_no"), none.alias("by_path"), none.alias("by_id"),
        F.concat(F.lit("l_"), "lang").alias("by_label"), F.lit("label").alias("by_type"), F.lit("append").alias("mode"),
        F.concat(F.lit("label "), "lang").alias("content"), no_vars.alias("variables"),
    )
    return X.apply_variant_patches(nodes, by_node.unionByName(by_label))


@query(
    "weighted_sample",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS weight FROM part WHERE p_size > 0
ORDER BY -ln((CAST(('0x' || left(md5('7:' || p_partkey), 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / p_size, p_partkey LIMIT 100""",
)
def weighted_sample(spark, folder):
    weighted = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("weight"))
    return X.weighted_sample(weighted, "p_partkey", "weight", 100, seed=7)


@query(
    "run_index",
    f"""WITH {RUNS_SQL} SELECT execution_id, workflow_id,
  row_number() OVER (PARTITION BY workflow_id ORDER BY ts, seq) AS run_index FROM runs""",
)
def run_index(spark, folder):
    facts = A.runs(spark, folder).select("workflow_id", "execution_id", "ts", "seq")
    return X.run_index(facts, ["workflow_id"], ["ts", "seq"]).select("execution_id", "workflow_id", "run_index")

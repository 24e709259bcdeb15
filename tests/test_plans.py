"""What the physical plans must and must not hold."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from runloom.plans import registry

PYTHON = ("similarity", "soft_reference_match", "issue_low_similarity", "rate_limit_admission", "read_reference_spec", "read_workflow_dsl")
SAMPLE = (
    "stats_by_workflow", "stats_global", "classify_runs", "normalize_status", "status_from_payload", "extract_placeholders", "guard_rewrite",
    "parse_sections", "extract_contract", "schema_strength", "prompt_locations", "cases_cartesian", "cases_pairwise", "run_index",
    "constraint_coverage", "merge_actions", "limit_actions", "overview_report", "plateau_detect",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_native_and_without_cross_joins(spark, folder, name):
    plan = plan_of(queries()[name](spark, folder))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


@pytest.mark.parametrize("name", ["limit_actions", "budget_actions", "beam_top_k", "limit_cases", "eval_subset"])
def test_rank_cuts_are_limited_before_the_shuffle(spark, folder, name):
    plan = plan_of(queries()[name](spark, folder))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_only_needed_columns_are_read(spark, folder):
    plan = plan_of(queries()["stats_by_workflow"](spark, folder))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "ts" not in {c.split(":")[0] for c in schema.split(",")}


def test_filters_reach_the_scan(spark, folder):
    plan = plan_of(queries()["daily_cost"](spark, folder))
    assert "GreaterThan(ts" in plan


def test_positions_are_not_windowed_over_a_whole_workflow(spark, folder):
    plan = plan_of(queries()["run_index"](spark, folder))
    wide = [w for w in re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)\)", plan) if "_chunk" not in w]
    assert not wide


def test_registered_names():
    assert set(oracle_sql()) <= set(queries())
    assert len(registry.QUERIES) >= 150
    # numbered queries and the pipeline belong to the subpackage that may be left out
    for name in registry.QUERIES:
        assert "pipeline" not in name and not re.match(r"op\d", name)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_no_local_checkpoints_or_collects_in_the_library():
    root = Path(__file__).parent.parent / "runloom"
    # the subpackage that may be left out has its own test, which names the bounded tables it collects
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm")
    for word in ("localCheckpoint", ".collect()", ".toPandas()", "crossJoin", ".rdd"):
        assert word not in text


def scans(spark, job) -> int:
    """How many times ``job`` reads a Parquet file, over all jobs it runs."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    before = executions()
    job()
    total = 0
    for number in executions() - before:
        nodes = store.planGraph(number).allNodes()
        total += sum(nodes.apply(i).name().startswith("Scan parquet") for i in range(nodes.size()))
    return total


@pytest.mark.parametrize("name, most", [("stats_global", 1), ("stats_by_workflow", 1), ("percentiles", 1), ("stats_by_dimensions", 1)])
def test_statistics_read_their_runs_once(spark, folder, name, most):
    assert scans(spark, lambda: queries()[name](spark, folder).collect()) == most


def test_issues_by_counts_read_the_runs_once(spark, folder):
    from runloom.operators import issues
    from runloom.sources import adapters

    runs = adapters.text_runs(spark, folder)
    alone = scans(spark, lambda: runs.select("workflow_id", "status", "duration_seconds").write.format("noop").mode("overwrite").save())
    specs = adapters.reference_specs(spark, folder)
    counted = scans(spark, lambda: issues._counted_heads(runs, specs, "workflow_id").collect())
    # the references come from a file of their own, which is read for the limits and for what has no runs
    assert counted <= alone + 2


def test_generated_cases_read_each_input_once(spark, folder):
    from runloom.plans import expand as plans
    from runloom.sources import adapters as A

    inputs = [A.plan(spark, folder), A.datasets(spark, folder), A.parameters(spark, folder), A.flows(spark, folder)]
    alone = [scans(spark, lambda d=d: d.write.format("noop").mode("overwrite").save()) for d in inputs]
    for mode in ("scenario_only", "cartesian", "pairwise", "hierarchical"):
        # datasets are read for their parameters and for the plan
        assert scans(spark, lambda m=mode: plans.plan_cases(spark, folder, m).collect()) <= sum(alone) + alone[1]

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.operators import reports as R


def facts(spark, rows):
    return spark.createDataFrame(rows, "workflow_id string, status string, execution_time double, tokens_used long, cost double")


def test_four_rows(spark):
    rows = [("w", "success", 1.0, 100, 0.01), ("w", "success", 2.0, 200, 0.02), ("w", "success", 3.0, 300, 0.03), ("w", "failed", 4.0, 400, 0.04)]
    m = M.run_metrics(facts(spark, rows)).first()
    assert (m.total_executions, m.successful_count, m.failed_count, m.success_rate) == (4, 3, 1, 0.75)
    assert (m.avg_execution_time, m.total_tokens) == (2.5, 1000)
    assert m.total_cost == pytest.approx(0.10)


def test_two_rows_by_workflow(spark):
    rows = [("w", "success", 1.5, 150, 0.01), ("w", "timeout", 3.0, 200, 0.02)]
    m = M.run_metrics(facts(spark, rows), ["workflow_id"]).first()
    assert (m.total_executions, m.success_rate, m.avg_execution_time, m.total_tokens) == (2, 0.5, 2.25, 350)
    assert m.avg_tokens_per_request == 175.0


def test_no_rows_give_no_statistics(spark):
    assert M.run_metrics(facts(spark, [])).count() == 0


def test_duplicates_count_twice(spark):
    rows = [("w", "success", 1.0, 1, 0.0)] * 2
    assert M.run_metrics(facts(spark, rows)).first().total_executions == 2


@pytest.mark.parametrize(
    "outputs", [{}, {"a": "b"}, {"answer": "x" * 400}, {"a": "1", "bb": "22", "ccc": "文字 emoji 🎉"}]
)
def test_repr_length(spark, outputs):
    df = spark.createDataFrame([(outputs,)], "o map<string,string>")
    assert df.select(M.repr_length(F.col("o"))).first()[0] == len(str(outputs))


@pytest.mark.parametrize(
    "seconds,efficiency,grade",
    [(1.99, 0.8, "excellent"), (2.0, 0.8, "good"), (1.0, 0.79, "good"), (5.0, 0.6, "fair"), (9.9, 0.4, "fair"), (10.0, 1.0, "poor"), (1.0, 0.39, "poor")],
)
def test_grade_cascade(spark, seconds, efficiency, grade):
    df = spark.createDataFrame([(seconds, efficiency)], "t double, e double")
    assert df.select(M.grade(F.col("t"), F.col("e"), M.THRESHOLDS)).first()[0] == grade


def test_zero_tokens_have_no_efficiency(spark):
    df = spark.createDataFrame([({"a": "b"}, 0), ({"a": "x" * 500}, 1)], "o map<string,string>, t long")
    assert [r[0] for r in df.select(M.token_efficiency(F.col("o"), F.col("t"))).collect()] == [0.0, 1.0]


def test_grades_without_runs_are_kept(runs):
    rows = M.grade_distribution(M.classify_runs(runs)).collect()
    assert {r.grade for r in rows} == set(M.GRADES)
    assert sum(r.n for r in rows) == 20
    assert sum(r.percent for r in rows) == pytest.approx(100.0)


def test_failure_rate_of_idle_workflow_is_one(spark, runs):
    workflows = spark.createDataFrame([("wf_0",), ("idle",)], "workflow_id string")
    rates = {r.workflow_id: r.failure_rate for r in M.failure_rate(workflows, runs).collect()}
    assert rates["idle"] == 1.0
    assert rates["wf_0"] == pytest.approx(2 / 7)


def test_run_statistics_leave_cancelled_out_of_the_rate(spark):
    rows = [("r", "succeeded", 1, 2.0), ("r", "failed", 3, 4.0), ("r", "cancelled", 1, 6.0)]
    df = spark.createDataFrame(rows, "run_id string, task_status string, attempt_count int, execution_time double")
    s = M.run_statistics(df.withColumns({"tokens_used": F.lit(1), "cost": F.lit(0.5)}), ["run_id"]).first()
    assert (s.total_tasks, s.completed_tasks, s.success_rate, s.total_retries) == (3, 2, 0.5, 2)
    assert s.avg_execution_time == 6.0


def test_export_needs_rows(spark, runs, tmp_path):
    graded = M.classify_runs(runs).withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "error_message": F.lit(None).cast("string")})
    R.export_results(graded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "details")).count() == 20
    with pytest.raises(Exception, match="no results"):
        R.export_results(graded.where("false"), str(tmp_path / "none"))


def test_failure_signature_normalizes_space(spark):
    df = spark.createDataFrame([("k", "a  b\n"), ("k", "a b"), ("k", "c")], "k string, t string")
    assert M.failure_signature(df, ["k"], "t").count() == 2

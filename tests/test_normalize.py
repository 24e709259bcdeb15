from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.functions import payload as P
from runloom.operators import normalize as N
from runloom.operators import validate as V


def read(spark, text, fn):
    return spark.createDataFrame([(text,)], "p string").withColumn("v", F.try_parse_json("p")).select(fn(F.col("v"), F.col("p"))).first()[0]


@pytest.mark.parametrize(
    "text,fine,coarse",
    [
        ('{"status":"success","output":"x"}', "success", "success"),
        ('{"result":{"data":{"status":"succeeded"}},"output":"fine"}', "success", "success"),
        ('{"status":"strange","data":{"state":"Timed_Out"}}', "timeout", "strange"),
        ('{"state":"partial"}', "partial_success", "partial"),
        ('{"status":"cancelled","result":"error"}', "canceled", "failed"),
        ('{"output":"x"}', "success", "success"),
        ('{"output":null}', "unknown", "unknown"),
        ("[1]", "unknown", "unknown"),
        ("no json", "unknown", "unknown"),
    ],
)
def test_status(spark, text, fine, coarse):
    assert read(spark, text, lambda v, _: N.status_from_payload(v)) == fine
    assert read(spark, text, lambda v, _: N.status_from_run(v)) == coarse


@pytest.mark.parametrize(
    "text,output,given",
    [
        ('{"output":{"text":"t"},"inputs":{"a":1}}', "t", '{"a":1}'),
        ('{"output":null,"data":"d","input":"","payload":"p"}', "d", "p"),
        ('{"response":7,"data":null}', "7", '{"response":7,"data":null}'),
        ('{"input":"i","data":{"inputs":[1],"request":"r"}}', '{"inputs":[1],"request":"r"}', "i\n[1]\nr"),
    ],
)
def test_texts(spark, text, output, given):
    assert read(spark, text, P.output_text) == output
    assert read(spark, text, P.workflow_input) == given


@pytest.mark.parametrize("name,folder", [("a/b\\c", "a_b_c"), ("..x y!!z..", "x_y_z"), ("///", "app"), ("文", "app"), ("ok-1.2_", "ok-1.2")])
def test_safe_dirname(spark, name, folder):
    assert spark.createDataFrame([(name,)], "n string").select(N.safe_dirname(F.col("n"))).first()[0] == folder


@pytest.mark.parametrize("state", ["pending", "queued", "running", "cancelled", "error", "weird"])
def test_unfinished_tasks_are_errors(spark, state):
    assert spark.createDataFrame([(state,)], "s string").select(N.run_status_of_task(F.col("s"))).first()[0] == "error"


def test_runtime_tokens(spark):
    df = spark.createDataFrame([({"q": "run-{ID}-{TIME}", "n": "id-{ID}"}, 1)], "m map<string,string>, i long")
    done = df.select(N.render_runtime_tokens(F.col("m"), F.col("i"), F.to_timestamp_ntz(F.lit("2025-01-01 01:01:01")))).first()[0]
    assert done == {"q": "run-1-20250101010101", "n": "id-1"}


def test_first_failing_rule_wins(spark):
    rows = [("", "", -1.0, -1, -1.0), ("w", "e", 0.0, 0, 0.0), ("w", "e", -0.1, -1, 0.0), ("w", None, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "workflow_id string, execution_id string, execution_time double, tokens_used long, cost double")
    valid, rejected = V.validate_runs(df)
    assert valid.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == [
        "execution_id is required", "execution_time must be non-negative", "workflow_id is required"
    ]


def test_plan_references(spark):
    plan = spark.createDataFrame([("a", ["d1", "d9"]), ("zz", ["d1"])], "catalog_id string, dataset_refs array<string>")
    bad = V.validate_plan_refs(plan, spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("d1",)], "dataset string"))
    assert {(r.catalog_id, r.kind, r.ref) for r in bad.collect()} == {("a", "dataset", "d9"), ("zz", "workflow", "zz")}


def test_scalar_inputs_need_no_reference_length(spark):
    inputs = spark.createDataFrame([("w", False, ["x"])], "workflow_id string, is_list boolean, values array<string>")
    refs = spark.createDataFrame([("w", True, ["a", "b"])], "workflow_id string, is_list boolean, values array<string>")
    assert V.validate_input_multiplicity(inputs, refs).first().reason is None

from __future__ import annotations

import json

from pyspark.sql import functions as F

from runloom.operators import rounds as R
from runloom.sources import files as FS


def test_one_record_per_file(spark, tmp_path):
    """Layout ``<id>/runs/run_<n>.json``: unreadable files are skipped, the index is a number."""
    folder = tmp_path / "my_flow" / "runs"
    folder.mkdir(parents=True)
    for n in (1, 2, 10):
        record = {"workflow_id": "my flow", "index": n, "result": {"status": "ok", "n": n}}
        (folder / f"run_{n}.json").write_text(json.dumps(record, indent=2))
    (folder / "run_3.json").write_text("{broken")
    (folder / "run_4.json").write_text(json.dumps({"status": "failed"}))
    rows = FS.read_run_records(spark, str(tmp_path), one_per_file=True).orderBy("index").collect()
    assert [(r.workflow_id, r["index"]) for r in rows] == [("my flow", 1), ("my flow", 2), ("my_flow", 4), ("my flow", 10)]
    assert json.loads(rows[0].payload) == {"status": "ok", "n": 1}
    assert json.loads(rows[2].payload) == {"status": "failed"}


def test_records_round_trip(spark, tmp_path):
    rows = [(w, i, "{}", f"r{i}", "{}") for w in ("a/b", "c") for i in range(5)]
    df = spark.createDataFrame(rows, FS.RECORD_SCHEMA)
    FS.write_run_records(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "workflow_dir=a_b").is_dir()
    back = {(r.workflow_id, r["index"], json.loads(r.payload)) for r in FS.read_run_records(spark, str(tmp_path / "out")).collect()}
    assert back == {(w, i, r) for w, i, _, r, _ in rows}


def test_reference_specs(spark, tmp_path):
    (tmp_path / "full.yaml").write_text("expected_outputs: [a, b]\nconstraints:\n  - Return JSON\nsimilarity_threshold: 0.5\nmax_latency_seconds: 3\n")
    (tmp_path / "plain.json").write_text('{"constraints": ["x"]}')
    (tmp_path / "list.yaml").write_text("- 1\n- 2\n")
    (tmp_path / "empty.yaml").write_text("\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in FS.read_reference_spec(spark, str(tmp_path)).collect()}
    assert (got["full.yaml"].expected_outputs, got["full.yaml"].similarity_threshold, got["full.yaml"].max_latency_seconds) == (["a", "b"], 0.5, 3.0)
    assert (got["plain.json"].constraints, got["plain.json"].max_failure_rate) == (["x"], 0.2)
    for name in ("list.yaml", "empty.yaml"):
        assert (got[name].constraints, got[name].similarity_threshold, got[name].max_latency_seconds) == ([], 0.72, None)


def test_first_existing_reference(spark, tmp_path):
    for name in ("my_flow.json", "my_flow.yml", "other id.json"):
        (tmp_path / name).write_text("{}")
    rows = [("my flow", None), ("other id", None), ("third", None), ("own", str(tmp_path / "my_flow.json")), ("gone", str(tmp_path / "no.yaml"))]
    workflows = spark.createDataFrame(rows, "workflow_id string, reference_path string")
    files = FS.listing(spark, str(tmp_path))
    got = {r.workflow_id: r.path.rsplit("/", 1)[1] for r in FS.resolve_reference_file(workflows, files, str(tmp_path)).collect()}
    assert got == {"my flow": "my_flow.yml", "other id": "other id.json", "own": "my_flow.json"}


def test_definitions_by_candidate_name(spark, tmp_path):
    (tmp_path / "my_flow").mkdir()
    (tmp_path / "my_flow" / "app_export.yaml").write_text("graph: {nodes: []}")
    (tmp_path / "my_flow" / "app_my_flow.yml").write_text("graph:\n  nodes:\n    - id: n1\n      data: {system_prompt: hello}\n")
    workflows = spark.createDataFrame([("my flow",), ("none",)], "workflow_id string")
    rows = FS.read_workflow_dsl(spark, workflows, str(tmp_path)).select("workflow_id", F.to_json("tree").alias("t")).collect()
    assert [(r.workflow_id, json.loads(r.t)["graph"]["nodes"][0]["id"]) for r in rows] == [("my flow", "n1")]


def test_states_are_appended_and_the_latest_is_found(spark, tmp_path):
    for step in range(3):
        FS.save_states(spark.createDataFrame([(1, step, f"s{step}"), (2, step * 2, f"t{step}")], "node_id long, step long, state string"), str(tmp_path / "s"))
        FS.append_timeline(spark.createDataFrame([(1, step)], "node_id long, step long"), str(tmp_path / "t"))
    latest = {r.node_id: r.state for r in R.latest_state(spark.read.parquet(str(tmp_path / "s")), "node_id").collect()}
    assert latest == {1: "s2", 2: "t2"}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_rejected_records_are_labelled_and_counted(spark, tmp_path):
    lines = ['{"workflow_id": "a", "index": 1, "result": {"x": 1}}', "{broken", "[1, 2]", "", "   ", '"text"', '{"workflow_id": "a"}', "null"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.json").write_text("\n".join(lines))
    records, rejected, counts = FS.sort_run_records(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r.reason, r.text) for r in rejected.collect()) == [
        ("empty", ""), ("empty", "   "), ("not JSON", "{broken"), ("not a JSON object", '"text"'), ("not a JSON object", "[1, 2]"), ("not a JSON object", "null"),
    ]
    assert counts == {"records": 8, "valid": 2, "empty": 2, "not JSON": 1, "not a JSON object": 3}
    assert {(r.workflow_id, r["index"]) for r in records.collect()} == {("a", 1), ("a", None)}
    assert all(r.path.endswith("lines.json") for r in rejected.collect())


def test_odd_references_are_labelled(spark, tmp_path):
    texts = {
        "fine.json": '{"constraints": ["x", 3], "max_latency_seconds": 2}', "fine.yaml": "constraints: [y]\nsimilarity_threshold: 0.4\n", "list.yaml": "- 1\n",
        "broken.yaml": "a: [1\nb: }", "blank.json": " \n", "kind.yaml": "constraints: text\nmax_failure_rate: 0.3\n", "number.json": '{"max_failure_rate": "often"}', "none.json": '{"constraints": null}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in FS.labelled_references(FS.read_documents(spark, str(tmp_path))).collect()}
    assert {n: r.reason for n, r in got.items()} == {
        "fine.json": None, "fine.yaml": None, "list.yaml": "no mapping", "broken.yaml": "no mapping", "blank.json": "empty", "kind.yaml": "constraints is no list",
        "number.json": "max_failure_rate is no number", "none.json": None,
    }
    assert (got["fine.json"].constraints, got["fine.json"].max_latency_seconds, got["fine.yaml"].similarity_threshold) == (["x", "3"], 2.0, 0.4)
    assert (got["kind.yaml"].constraints, got["kind.yaml"].max_failure_rate, got["number.json"].max_failure_rate) == ([], 0.3, 0.2)


def test_runs_without_reference_say_why(spark):
    from runloom.operators.expand import align_references, labelled_alignment

    runs = spark.createDataFrame([(w, i) for w in ("one", "two", "none") for i in range(1, 5)], "workflow_id string, index long")
    texts = spark.createDataFrame([("one", 1, "r"), ("two", 1, "a"), ("two", 2, None), ("two", 3, "c")], "workflow_id string, index long, reference_text string")
    got = {(r.workflow_id, r["index"]): (r.reference_text, r.reason) for r in labelled_alignment(runs, texts).collect()}
    assert [got["one", i] for i in range(1, 5)] == [("r", None)] * 4
    assert [got["two", i] for i in range(1, 5)] == [("a", None), (None, "reference is missing"), ("c", None), (None, "beyond the last reference")]
    assert {got["none", i] for i in range(1, 5)} == {(None, "workflow has no reference")}
    assert align_references(runs, texts).count() == 4 + 3


def test_a_key_is_read_from_the_files_that_hold_it(spark, tmp_path):
    from runloom.sources import store as ST

    folder = str(tmp_path / "store")
    rows = [(f"k{i:03d}", j, f"{i}-{j}") for i in range(100) for j in range(10)] + [("k050", j, f"hot-{j}") for j in range(10, 600)] + [(None, 0, "none")]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    ST.write_store(df, folder, "k", ["n"], rows_per_file=100)
    index = ST.store_index(spark, folder).collect()
    assert sum(r.rows for r in index) == len(rows) and len(index) == 16
    for key in ("k007", "k050", "k099", "none of them", None):
        got = ST.read_key(spark, folder, "k", key)
        assert sorted(r.v for r in got.collect()) == sorted(v for k, _, v in rows if k == key)
        opened = len(got.inputFiles())
        assert opened <= (9 if key == "k050" else 2)
    assert ST.read_store(spark, folder).count() == len(rows)

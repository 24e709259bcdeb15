"""Issues, actions and the step loop on small fixtures."""

from __future__ import annotations

import difflib
import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.functions import prompts as P
from runloom.operators import actions as AC
from runloom.operators import dsl as D
from runloom.operators import issues as I
from runloom.operators import rounds as R
from runloom.operators import states as S
from runloom.session import checkpointed, shared_folder

SPEC = "workflow_id string, expected_outputs array<string>, constraints array<string>, similarity_threshold double, max_failure_rate double, max_latency_seconds double"
SAMPLES = "workflow_id string, index long, status string, output_text string, duration_seconds double"


@pytest.fixture(scope="module")
def specs(spark):
    rows = [("w", ["the expected answer"], ["Return JSON", "Polite"], 0.72, 0.2, 3.0), ("idle", [], [], None, None, None)]
    return spark.createDataFrame(rows, SPEC)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("w", 1, "success", "the expected answer, polite", 1.0), ("w", 2, "failed", "something else, polite", 5.0), ("w", 3, "success", None, None)]
    return spark.createDataFrame(rows, SAMPLES)


def by_kind(issues):
    out = {}
    for r in issues.collect():
        out.setdefault((r.kind, r.message, r.severity), set()).add(r.evidence_run)
    return out


def test_detect_issues(samples, specs):
    got = by_kind(I.detect_issues(samples, specs).where("workflow_id = 'w'"))
    mean = sum(difflib.SequenceMatcher(None, "the expected answer", t).ratio() for t in ("the expected answer, polite", "something else, polite")) / 2
    low = ("low_similarity", f"Average similarity {mean:.2f} below threshold 0.72", "medium" if mean > 0.72 * 0.7 else "high")
    assert got == {
        ("high_failure_rate", "Failure rate 0.33 exceeds threshold 0.20", "high"): {2},
        low: {1, 2, 3},
        ("constraint_missing", "Constraint not observed in outputs: Return JSON", "high"): {1, 2, 3},
        ("latency_exceeded", "Latency exceeded 3.0s in 1 runs", "medium"): {2},
    }
    idle = I.detect_issues(samples, specs).where("workflow_id = 'idle'").collect()
    assert [(r.kind, r.evidence_run) for r in idle] == [("insufficient_data", None)]


def test_rate_at_the_limit_is_no_issue(spark, specs):
    rows = [("w", i, "failed" if i == 1 else "success", "x", 0.0) for i in range(1, 6)]
    assert I.issue_high_failure_rate(spark.createDataFrame(rows, SAMPLES), specs).count() == 0


def test_actions_of_issues(samples, specs):
    issues = checkpointed(I.detect_issues(samples, specs))
    heads = {(r.workflow_id, r.type, r.target, r.content): r.evidence_count for r in AC.action_headers(AC.actions_from_issues(issues, specs)).collect()}
    assert heads[("w", "add_global_constraint", "Return JSON", "Return JSON")] == 3
    assert {k[1] for k in heads if k[0] == "w"} == {"add_global_constraint", "modify_checkpoint_rule"}
    assert not [k for k in heads if k[0] == "idle"]


def test_signal_is_the_fallback(spark, specs):
    rows = [("w", i, "failed", "the expected answer Return JSON polite", 0.0) for i in (1, 2)]
    issues = I.issue_high_failure_rate(spark.createDataFrame(rows, SAMPLES), specs)
    got = {r.content: r.evidence_count for r in AC.action_headers(AC.actions_from_issues(issues, specs)).collect()}
    assert got == {"Ensure constraint is satisfied: Return JSON": 2, "Ensure constraint is satisfied: Polite": 2}


def test_merge_rules(spark):
    rows = [
        ("w", 1, "Add_Checkpoint_Rule", "t", "short", 1), ("w", 2, "add_checkpoint_rule", " t ", "longer", 2),
        ("w", 3, "add_global_constraint", None, "c", 5), ("w", 4, "add_global_constraint", None, "c", 6), ("w", 5, "rewrite", None, None, None),
    ]
    df = spark.createDataFrame(rows, "workflow_id string, seq long, type string, target string, content string, evidence_run long")
    got = {(r.type, r.target, r.content): r.evidence_count for r in AC.action_headers(AC.merge_actions(df)).collect()}
    assert got == {("add_checkpoint_rule", "t", "longer"): 2, ("add_global_constraint", None, "c"): 1, ("rewrite", None, None): 0}


def test_ties_keep_the_later_rule(spark):
    rows = [("w", 1, "add_checkpoint_rule", "", "a", 1), ("w", 2, "add_checkpoint_rule", None, "b", 2), ("w", 3, "tighten_schema", None, "", 3)]
    df = spark.createDataFrame(rows, "workflow_id string, seq long, type string, target string, content string, evidence_run long")
    got = AC.normalize_actions(df).collect()
    assert [(r.seq, r.target, r.content, r.evidence_run) for r in got] == [(1, "generic", "b", 2)]


def state_of(spark, text):
    df = spark.createDataFrame([(1, text)], "node_id long, t string")
    return P.with_prompt_state(df, "t", F.array().cast("array<string>")).select("node_id", "state")


def acted(spark, text, actions, **kw):
    rows = [(1, i, *a) for i, a in enumerate(actions)]
    df = spark.createDataFrame(rows, "node_id long, seq long, type string, target string, content string")
    return S.apply_actions(state_of(spark, text), df, "node_id", **kw).first().state


def test_schema_actions(spark):
    schema = '{"required":["a"],"properties":{"a":{"type":"string"}}}'
    s = acted(spark, "plain", [("tighten_schema", None, schema), ("tighten_schema", "a", "enum: ['x', 'y']"), ("tighten_schema", None, '{"required":["z","y","x","w"]}')], budget=9)
    assert json.loads(s.schema) == {"required": ["a"], "properties": {"a": {"type": "string", "enum": ["x", "y"]}}}
    assert (s.schema_tighten_count, s.schema_frozen, s.version) == (2, True, 1)


def test_weaker_schema_and_description(spark):
    schema = '{"required":["a"],"properties":{"a":{"description":"old"}}}'
    s = acted(spark, "plain", [("tighten_schema", None, schema), ("tighten_schema", None, '{"properties":{}}')], budget=9)
    assert json.loads(s.schema)["required"] == ["a"]
    s = acted(spark, "plain", [("tighten_schema", None, schema), ("tighten_schema", "a", 'say "hi"')], budget=9)
    assert json.loads(s.schema)["properties"]["a"]["description"] == 'old say "hi"'


def test_contract_is_protected_and_strictness_clamped(spark):
    text = "ROLE:\nr\nJSON SCHEMA:\n{\"a\":1}\nSTRICTNESS LEVEL:\n9"
    s = acted(spark, text, [("tighten_schema", None, '{"required":["b"]}'), ("increase_strictness", None, None), ("add_global_constraint", "response_contract", "no"), ("add_checkpoint_rule", "k", "v")])
    assert (s.contract, s.schema, s.strictness_level, s.global_constraints) == ('{"a":1}', "", 5, [])
    assert [(r.key, r.value) for r in s.checkpoint_rules] == [("k", "v")]


def test_constraints_are_capped(spark):
    s = acted(spark, "x", [("add_global_constraint", None, f"c{i}") for i in range(30)], budget=50, max_constraints=20)
    assert s.global_constraints == [f"c{i}" for i in range(10, 30)]
    whole = acted(spark, "x", [("add_global_constraint", None, f"c{i}") for i in range(30)])
    assert whole.global_constraints == [f"c{i}" for i in range(30)]


def test_candidates_are_evaluated_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 3}", "in") for i in range(30)], "id long, prompt string, workflow_input string")
    folder = tmp_path / "calls"
    folder.mkdir()

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        import uuid

        (folder / uuid.uuid4().hex).write_text("\n".join(batch["prompt"]))
        return batch.assign(output_text=batch["prompt"].str.upper(), status="success")

    rows = S.evaluate_candidates(df, S.function_evaluator(answer)).collect()
    assert len(rows) == 30 and all(r.output_text == r.prompt.upper() for r in rows)
    called = [line for f in folder.iterdir() for line in f.read_text().splitlines()]
    assert sorted(called) == ["p0", "p1", "p2"]


def echo(rows):
    return rows.select("prompt_hash", "input_hash", F.concat_ws(" ", "prompt", "workflow_input").alias("output_text"), F.lit("success").alias("status"))


def test_steps_add_the_missing_constraint(spark):
    specs = spark.createDataFrame([("w", [], ["Return JSON"], 0.72, 0.2, None)], SPEC)
    prompts = state_of(spark, "TASK:\nanswer the question of the user in full sentences, please, and always stay polite\n").select(
        "node_id", F.lit("w").alias("workflow_id"), F.lit("in").alias("workflow_input"), "state"
    )
    final, timeline = S.optimize_prompts(prompts, specs, echo, max_steps=2, options=S.StepOptions(beam_width=2))
    row = final.first()
    assert row.state.global_constraints == ["Return JSON"]
    # the constraint holds the word json, so its absence is a format issue and the stage stays FORMAT at first
    steps = [(r.step, r.issue_count, r.stop_reason) for r in timeline.orderBy("step").collect()]
    assert steps == [(0, 1, None), (1, 0, "no_issues")]
    assert row.stop_reason == "no_issues"


def held_bytes(spark) -> int:
    return sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())


def test_a_step_holds_few_copies_of_the_texts(spark):
    """Shared folder after a step: the new nodes and the new beam, not every trial with its state, prompt and answer."""
    specs = spark.createDataFrame([("w", [], ["Return JSON"], 0.72, 0.2, None)], SPEC)
    drawn = random.Random(7)
    texts = ["".join(drawn.choices("abcdefghijklmnopqrstuvwxyz0123456789+ACDEFGHIJKLMNOPQRSTUVWXYZ", k=40_000)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "node_id long, prompt string")
    built = P.with_prompt_state(rows, "prompt", F.array().cast("array<string>"))
    prompts = built.select("node_id", F.lit("w").alias("workflow_id"), F.lit("in").alias("workflow_input"), "state")
    nodes, beam = S.start_nodes(prompts)
    before = held_bytes(spark)
    nodes, beam, timeline = S.optimize_step(nodes, beam, specs, echo, 0)
    held = (held_bytes(spark) - before) / sum(map(len, texts))
    assert (nodes.count(), beam.count(), timeline.count()) == (60, 60, 60)
    assert held < 4, held


def test_parts_of_a_step_change_nothing_and_evaluate_once(spark, tmp_path, monkeypatch):
    """Equal prompts of different nodes, a node that comes twice and one without a reference."""
    specs = spark.createDataFrame([("w", ["answer with care"], ["Return JSON", "Polite"], 0.72, 0.2, None), ("v", ["polite"], ["Polite"], 0.1, 0.2, None)], SPEC)
    rows = [(i, ("w", "v", None)[i % 3], f"TASK:\nanswer the question {i % 4} of the user{', polite' if i % 5 else ''}\nSTRICTNESS LEVEL:\n{1 + i % 2}\n") for i in range(12)]
    rows += [(3, "w", rows[3][2]), (4, "w", rows[4][2])]
    built = P.with_prompt_state(spark.createDataFrame(rows, "node_id long, workflow_id string, prompt string"), "prompt", F.array().cast("array<string>"))
    prompts = built.select("node_id", "workflow_id", F.lit("in").alias("workflow_input"), "state")

    def stepped(parts: int, name: str):
        folder = tmp_path / name
        folder.mkdir()

        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            import uuid

            (folder / uuid.uuid4().hex).write_text("\n".join(batch["prompt_hash"]))
            return batch.assign(output_text=batch["prompt"] + " " + batch["workflow_input"], status="success")

        nodes, beam = S.start_nodes(prompts)
        nodes, beam, timeline = S.optimize_step(nodes, beam, specs, S.function_evaluator(answer), 0, S.StepOptions(beam_width=2, parts=parts))
        called = [line for f in folder.iterdir() for line in f.read_text().splitlines()]
        assert len(called) == len(set(called)) > 1
        return sorted(called), *(sorted(map(str, df.collect())) for df in (nodes, beam, timeline))

    whole = stepped(1, "whole")
    monkeypatch.setattr(S, "PART_LENGTH", 100)
    assert stepped(3, "parts") == whole and len(whole[1]) == 14  # of a node that comes twice each row advances


def test_round_report(spark, samples, specs):
    tree = {"graph": {"nodes": [{"id": "n", "type": "llm", "data": {"prompt_template": [{"role": "system", "text": "Return JSON, polite expected answer {{x}}"}]}}]}}
    trees = spark.createDataFrame([(1, "w", json.dumps(tree))], "tree_id long, workflow_id string, t string").withColumn("tree", F.try_parse_json("t"))
    blocks = D.prompt_blocks(D.dsl_nodes(trees, ["tree_id", "workflow_id"], "tree"), ["tree_id", "workflow_id"])
    rewrites = blocks.select("tree_id", "node_id", F.replace("merged_text", F.lit("polite"), F.lit("kind")).alias("rewritten"))
    refs = specs.select("workflow_id", F.lit("r").alias("reference_text"))
    result = R.optimize_runs(samples, specs, blocks, rewrites, refs)
    patch = result.patches.first()
    assert (patch.path, patch.new) == ("/graph/nodes/0/data/prompt_template/0/text", "Return JSON, kind expected answer {{x}}")
    stats = result.stats.first()
    assert (stats.runs, stats.failures, stats.prompts_need_change) == (3, 1, 1)
    sections = {r.section for r in R.patches_report(result).collect()}
    assert sections == {"issues", "actions", "patches", "stats"}


def test_generated_variants_none_one_and_many(spark):
    states = state_of(spark, "plain").crossJoin(spark.createDataFrame([(i,) for i in range(3)], "beam_no long"))

    def generate(given):
        many = F.array_repeat(F.lit(0), F.when(F.col("beam_no") == 2, 5).otherwise(F.col("beam_no")).cast("int"))
        made = given.select("*", F.posexplode(many).alias("variant_no", "_x")).drop("_x")
        return made.withColumn("state", F.col("state").withField("role", F.concat(F.lit("v"), F.col("variant_no").cast("string"))))

    def found(**options):
        rows = S.variant_states(states, generate=generate, keys=["node_id", "beam_no"], **options).collect()
        return sorted((r.beam_no, r.variant_no, r.state.role) for r in rows)

    as_it_is = states.first().state.role
    assert found() == sorted([(0, 0, as_it_is), (1, 0, "v0"), *((2, i, f"v{i}") for i in range(5))])
    assert found(count=2) == sorted([(0, 0, as_it_is), (1, 0, "v0"), (2, 0, "v0"), (2, 1, "v1")])
    assert S.variant_states(states).count() == 9 and S.variant_states(states, 2).count() == 6


def test_actions_are_merged_before_they_are_applied(spark):
    rows = [
        (1, 1, "add_checkpoint_rule", "tone", "calm", 1), (1, 2, "Add_Checkpoint_Rule", " tone ", "sharp", 2), (1, 2, "Add_Checkpoint_Rule", " tone ", "sharp", 3),
        (1, 3, "add_global_constraint", None, "use en", 1), (1, 4, "add_global_constraint", None, " use en", 2), (1, 5, "increase_strictness", None, "a", 1), (1, 6, "increase_strictness", None, "b", 1),
    ]
    actions = spark.createDataFrame(rows, "node_id long, seq long, type string, target string, content string, evidence_run long")
    states = state_of(spark, "plain")
    level = states.first().state.strictness_level
    for given in (actions, AC.action_headers(actions, "node_id")):
        s = S.apply_actions(states, given, "node_id", normalize=True).first().state
        assert [(r.key, r.value) for r in s.checkpoint_rules] == [("tone", "sharp")]
        assert s.global_constraints == ["use en"] and s.strictness_level == min(5, level + 1)
    one = S.apply_actions(states, actions, "node_id", budget=1, normalize=True).first().state
    assert [r.value for r in one.checkpoint_rules] == ["sharp"] and one.global_constraints == [] and one.strictness_level == level

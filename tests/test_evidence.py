"""Evidence as shared bitmaps: linear in issues and runs, and the same runs as explicit rows."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runloom.operators import actions as AC
from runloom.operators import evidence as E
from runloom.operators import issues as I

SAMPLES = "workflow_id string, index long, status string, output_text string, duration_seconds double"
SPECS = "workflow_id string, expected_outputs array<string>, constraints array<string>, similarity_threshold double, max_failure_rate double, max_latency_seconds double"


def test_bitmaps_hold_any_run_number(spark):
    rng = random.Random(3)
    runs = {rng.randrange(-10**6, 10**6) for _ in range(400)} | {0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, (1 << 63) - 1, -(1 << 62)}
    rows = [("a", r) for r in runs] * 2 + [("b", 7), ("c", None)]
    sets = E.bitmaps(spark.createDataFrame(rows, "k string, evidence_run long"), ["k"])
    back = E.runs(sets, ["k"]).collect()
    assert sorted(r.evidence_run for r in back if r.k == "a") == sorted(runs)
    assert {r.k: r.evidence_count for r in E.sizes(sets, ["k"]).collect()} == {"a": len(runs), "b": 1}
    both = E.united(sets.withColumn("k", F.lit("x")), ["k"])
    assert sorted(r.evidence_run for r in E.runs(both, ["k"]).collect()) == sorted(runs | {7})


@pytest.fixture(scope="module")
def workflow(spark):
    """3,000 runs of one workflow, 60 constraints that none shows, failures and slow runs; and one that is fine."""
    rows = [("w", i, "failed" if i % 3 == 0 else "success", "text", 9.0 if i % 4 == 0 else 1.0) for i in range(1, 3001)]
    rows += [("fine", i, "success", "c1 c2", 1.0) for i in range(10)]
    specs = [("w", ["e"], [f"constraint {i}" for i in range(60)], 0.0, 0.1, 5.0), ("fine", ["e"], ["C1"], 0.0, None, None), ("idle", [], None, None, None, None)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(specs, SPECS)


def test_issues_and_runs_do_not_multiply(workflow):
    samples, specs = workflow
    heads = I.detect_heads(samples, specs, similarity=False).cache()
    sets = I.evidence_sets(samples, specs, heads).cache()
    assert heads.count() == 60 + 3 and sets.count() == 3
    counts = {(r.kind, r.evidence_count) for r in I.with_evidence_count(heads, sets).collect()}
    assert counts == {("constraint_missing", 3000), ("high_failure_rate", 1000), ("latency_exceeded", 750), ("insufficient_data", 0)}
    actions, own = AC.signal_heads(heads, sets, specs)
    # each gap is named by two signals
    assert actions.count() == 2 * 60 and own.count() == 1
    mapped, every = AC.head_actions(heads, sets, specs)
    assert mapped.count() == 60 and {r.evidence_count for r in mapped.collect()} == {3000} and every.count() <= 5


def test_explicit_rows_equal_those_of_each_kind(workflow):
    samples, specs = workflow
    heads = I.detect_heads(samples, specs, similarity=False)
    columns = ["workflow_id", *I.SHOWN, "evidence_run"]
    kinds = [I.issue_insufficient_data(specs, samples), I.issue_high_failure_rate(samples, specs), I.issue_constraint_missing(samples, specs), I.issue_latency_exceeded(samples, specs)]
    want = sorted((tuple(r) for k in kinds for r in k.select(columns).collect()), key=str)
    got = I.explicit_evidence(heads, I.evidence_sets(samples, specs, heads)).select(columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    issues = got.cache()
    signal = AC.actions_from_signal(issues, specs)
    heads_of, own = AC.signal_heads(heads, I.evidence_sets(samples, specs, heads), specs)
    names = ["workflow_id", "type", "content", "evidence_run"]
    spread = I.explicit_evidence(heads_of, own, columns=AC.ACTION)
    assert sorted(map(str, signal.select(names).collect())) == sorted(map(str, spread.select(names).collect()))
    assert signal.where("workflow_id = 'w'").select("evidence_run").distinct().count() == 3000


def test_issues_of_any_index_keep_their_order(spark):
    rows = [("w", 10**12 + 5, False, "m", "high"), ("w", (1 << 63) - 1, False, "m", "high"), ("w", 3, False, "m", "high")]
    judged = spark.createDataFrame(rows, "workflow_id string, index long, passed boolean, message string, severity string")
    calls = judged.select("workflow_id", F.lit(None).cast("string").alias("raw"))
    mismatch = [r.issue_seq for r in I.output_mismatch_heads(judged).collect()]
    unreliable = I.judge_unreliable_heads(judged.where("false"), calls).first().issue_seq
    missing = I._sequence(3, F.lit((1 << 63) - 1))
    assert len(set(mismatch)) == 3 and max(mismatch) < unreliable and spark.range(1).select(missing.alias("s")).first().s < min(mismatch)


def plain_merge(rows):
    out = {}
    for _, seq, kind, target, content, run in sorted(rows, key=lambda r: r[1]):
        kind, target, content = kind.strip().lower(), target and target.strip(), content and content.strip()
        if kind == "add_global_constraint":
            if content:
                at = out.setdefault((kind, "", content), {"seq": seq, "target": target, "content": content, "runs": set()})
                if at["seq"] == seq:
                    at["runs"].add(run)
        else:
            at = out.setdefault((kind, target, None), {"seq": seq, "target": target, "content": content, "runs": set()})
            at["runs"].add(run)
            if len(content or "") > len(at["content"] or ""):
                at["content"] = content
    return sorted((a["seq"], k[0], a["target"], a["content"], tuple(sorted(a["runs"] - {None}))) for k, a in out.items())


def test_merged_actions_equal_a_plain_version(spark):
    rng = random.Random(4)
    texts = {i: (rng.choice(["Rewrite", " add_global_constraint", "tighten_schema "]), rng.choice([None, " a", "b"]), rng.choice(["", "x", " yy", "zz", "long one"])) for i in range(60)}
    rows = [("n", i, *texts[i], rng.choice([None, *range(20)])) for i in range(60) for _ in range(rng.randrange(1, 4))]
    actions = spark.createDataFrame(rows, "workflow_id string, seq long, type string, target string, content string, evidence_run long")
    want = plain_merge(rows)
    heads, _ = AC.merge_heads(actions)
    assert sorted((r.seq, r.type, r.target, r.content, r.evidence_count) for r in heads.collect()) == sorted((*w[:4], len(w[4])) for w in want)
    got = {}
    for r in AC.merge_actions(actions).collect():
        got.setdefault((r.seq, r.type, r.target, r.content), []).append(r.evidence_run)
    assert sorted((*k, tuple(sorted(x for x in v if x is not None))) for k, v in got.items()) == want
    normal = AC.normalize_actions(actions)
    assert sorted(map(str, AC.action_headers(normal).collect())) == sorted(map(str, AC.normalize_heads(actions).collect()))


def test_merged_and_signalled_runs_are_rows_and_need_no_bitmaps(spark):
    rows = [(f"t{i}", Decimal(0), "constraint_missing", "high", "Constraint not observed in outputs: c", 1) for i in range(3)] + [(None, Decimal(0), "latency_exceeded", "low", "m", 1)]
    issues = spark.createDataFrame(rows, "trial_id string, issue_seq decimal(38,0), kind string, severity string, message string, evidence_run long")
    specs = spark.createDataFrame([("t0", ["c", "d"]), ("t1", ["c"])], "trial_id string, constraints array<string>")
    signal = AC.actions_from_signal(issues, specs, "trial_id")
    found = {(r.trial_id, r.type, r.evidence_run) for r in signal.collect()}
    assert ("t0", "add_global_constraint", 1) in found and ("t2", "add_checkpoint_rule", 1) in found
    actions = spark.createDataFrame(
        [("t0", 1, "Rewrite", None, "x", 1), ("t0", 2, "rewrite", None, "longer", 1), ("t0", 3, "rewrite", "a", "y", None), (None, 4, "rewrite", "a", "y", None)],
        "trial_id string, seq long, type string, target string, content string, evidence_run long",
    )
    merged = AC.merge_actions(actions, "trial_id")
    assert sorted(map(str, (tuple(r) for r in merged.collect()))) == sorted(map(str, [("t0", 1, "rewrite", None, "longer", 1), ("t0", 3, "rewrite", "a", "y", None), (None, 4, "rewrite", "a", "y", None)]))
    for df in (signal, merged):
        assert "bitmap" not in df._jdf.queryExecution().optimizedPlan().toString()

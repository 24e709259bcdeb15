from __future__ import annotations

import random

from pyspark.sql import functions as F

from runloom.operators import history as H


def test_stop_rules_match_a_loop(spark):
    rng = random.Random(2)
    rows = [("w" if i % 4 else "v", i, rng.choice(["succeeded", "failed", "error", "timeout"])) for i in range(400)]
    placed, counters = [], {"w": 0, "v": 0}
    for w, _, s in rows:
        counters[w] += 1
        placed.append((w, counters[w], s))
    df = H.split_batches(spark.createDataFrame(placed, "workflow_id string, index long, task_status string"), 7)
    for limit in (0, 1, 20, 10_000):
        got = {(r.workflow_id, r["index"]): r.final_status for r in H.stop_max_failures(df, limit).collect()}
        for w in "wv":
            mine = [p for p in placed if p[0] == w]
            failures = 0
            for start in range(0, len(mine), 7):
                batch = mine[start : start + 7]
                stopped = failures >= limit
                for _, index, state in batch:
                    assert got[(w, index)] == ("cancelled" if stopped else state)
                if not stopped:
                    failures += sum(s in ("failed", "error", "timeout") for _, _, s in batch)


def _steps(spark, values, **columns):
    rows = [(1, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "node_id long, step long, score double")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_plateau_rolls_back_to_the_first_best(spark):
    row = H.plateau_detect(_steps(spark, [5, 7, 7, 6, 7, 9]), "node_id").first()
    assert (row.stop_step, row.best_step, row.best_score) == (4, 1, 7.0)
    row = H.plateau_detect(_steps(spark, [1, 2, 2, 3]), "node_id").first()
    assert (row.stop_step, row.best_step) == (None, 3)


def test_stages(spark):
    flags = [True, False, True, False, False, True, False]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "node_id long, step long, has_format_issue boolean")
    stage, clean, wanted = "FORMAT", 0, []
    for bad in flags:
        if stage == "FORMAT" and not bad:
            stage = "RECALL"
        elif stage == "RECALL":
            clean = 0 if bad else clean + 1
            if clean >= 2:
                stage = "STRICT"
        wanted.append(stage)
    assert [r.stage for r in H.stage_progress(df, "node_id").orderBy("step").collect()] == wanted


def test_loop_stop_reasons(spark):
    rows = [("a", 1, 1, 0.5, None), ("a", 2, 0, 0.0, None), ("a", 3, 1, 0.5, None), ("b", 1, 0, 0.9, 0.9), ("c", 1, 1, 0.9, None), ("c", 2, 1, 0.9, None)]
    df = spark.createDataFrame(rows, "workflow_id string, cycle int, patches int, failure_rate double, skip_ratio double")
    out = H.loop_stop(df, "workflow_id", 1, target_failure_rate=0.1, exit_ratio=0.8, max_cycles=2)
    got = {(r.workflow_id, r.cycle): r.stop_reason for r in out.collect()}
    assert got == {("a", 1): None, ("a", 2): "target_met", ("b", 1): "skip_ratio", ("c", 1): None, ("c", 2): "max_cycles"}


def test_slot_freeze_matches_a_loop(spark):
    rng = random.Random(4)
    flags = [rng.random() < 0.25 for _ in range(40)]
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(flags)], "slot string, step long, accepted boolean")
    got = [r.frozen_until for r in H.slot_freeze(df, ["slot"]).orderBy("step").collect()]
    no_gain, accepted, frozen, wanted = 0, 0, -1, []
    for step, ok in enumerate(flags):
        if ok:
            accepted, no_gain, frozen = accepted + 1, 0, -1
        else:
            no_gain += 1
            if accepted > 0 and no_gain >= 2:
                frozen = step + 1
            elif accepted == 0 and no_gain >= 3:
                frozen = step + 2
        wanted.append(frozen)
    assert got == wanted


def test_cap_keeps_the_last(spark):
    df = spark.range(1).select(H.cap_constraints(F.sequence(F.lit(1), F.lit(30)), 20).alias("a"), H.cap_constraints(F.sequence(F.lit(1), F.lit(3)), 20).alias("b"))
    row = df.first()
    assert row.a == list(range(11, 31)) and row.b == [1, 2, 3]


def test_dedupe_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", "x", 3)], "t string, c string, seq long")
    assert {(r.t, r.c, r.seq) for r in H.dedupe_keep_first(df, ["t", "c"], "seq").collect()} == {("a", None, 1), ("a", "x", 3)}


def test_eval_subset_rules(spark):
    rows = [(n, i, i >= bad) for n, (size, bad) in enumerate([(5, 1), (10, 0), (10, 5), (10, 2), (8, 7)]) for i in range(size)]
    df = spark.createDataFrame(rows, "node_id long, run_index long, passed boolean")
    sizes = {r.node_id: r["count"] for r in H.eval_subset(df, ["node_id"], minimum=8).groupBy("node_id").count().collect()}
    assert sizes == {0: 5, 1: 10, 2: 5, 3: 5, 4: 7}

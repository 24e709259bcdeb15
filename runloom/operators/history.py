"""Ordered analysis of runs, attempts, trials and cycles.

Over runs, where one workflow may hold most rows, every operator is an aggregate, a rank cut that Spark
limits per task before the shuffle, or a position from :mod:`runloom.operators.ordering`. Windows over a
whole key occur only on step tables (trials, cycles, attempts), whose keys have one row per step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.functions.text import draw_order, prompt_hash
from runloom.operators.metrics import SUCCESS, is_success, join_on, seconds_between
from runloom.operators.ordering import ranks_of_counts
from runloom.session import checkpointed

# Order of action types when only some may be kept.
ACTION_PRIORITY = {
    "tighten_schema": 0,
    "add_checkpoint_rule": 1,
    "modify_checkpoint_rule": 1,
    "add_global_constraint": 2,
    "increase_strictness": 3,
}
LAST_PRIORITY = 99
# Budgets and limits of the step loop.
ACTION_BUDGET = 5
MAX_CONSTRAINTS = 20
NO_IMPROVE_ROUNDS = 3
MAX_PROMPT_GROWTH = 1.5
EVAL_MINIMUM, EVAL_DRAW = 8, 3
FAILED_STATES = ("failed", "error", "timeout")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per key in ``order``.

    Spark cuts each task's rows to the limit before the shuffle as long as ``k`` does not exceed
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 unless set).
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


# Runs and batches --------------------------------------------------------------------------------


def representative_run(runs: DataFrame, success: Sequence[str] = SUCCESS) -> DataFrame:
    """First run that did not succeed, else the first run, per workflow."""
    others = [c for c in runs.columns if c != "workflow_id"]
    picked = runs.groupBy("workflow_id").agg(
        F.min_by(F.struct(*others), F.struct(is_success(F.col("status"), success), F.col("index"))).alias("r")
    )
    return picked.select("workflow_id", "r.*")


def split_batches(runs: DataFrame, size: int) -> DataFrame:
    """Batch number from the 1-based position."""
    return runs.withColumn("batch", F.floor((F.col("index") - 1) / size).cast("long"))


def _cancel_after(tasks: DataFrame, last: DataFrame, everything: bool) -> DataFrame:
    joined = tasks.join(last, "workflow_id", "left")
    stopped = F.lit(True) if everything else F.coalesce(F.col("batch") > F.col("_last"), F.lit(False))
    return joined.withColumn("final_status", F.when(stopped, "cancelled").otherwise(F.col("task_status"))).withColumn(
        "stop_message", F.when(stopped, "Stopped due to stop conditions")
    ).drop("_last")


def stop_max_failures(tasks: DataFrame, max_failures: int) -> DataFrame:
    """Cancel every batch after the one in which the ``max_failures``-th failure happened.

    ``tasks`` has ``workflow_id, batch, task_status``; batches follow each other by their number. Failures are counted per
    batch, and only the batches are ranked, in chunks, so that a workflow that holds most of them is spread out
    whatever ``max_failures`` is.
    """
    failures = tasks.where(F.col("task_status").isin(*FAILED_STATES))
    counts = checkpointed(failures.groupBy("workflow_id", "batch").agg(F.count(F.lit(1)).alias("_n")))
    ranks = ranks_of_counts(counts, ["workflow_id"], "batch")
    last = ranks.where(F.lit(max(max_failures, 1) - 1).between(F.col("lo"), F.col("hi"))).select("workflow_id", F.col("batch").alias("_last"))
    return _cancel_after(tasks, last, max_failures <= 0)


def stop_timeout(tasks: DataFrame, timeout_seconds: float) -> DataFrame:
    """Cancel every batch that starts ``timeout_seconds`` or more after the first start."""
    starts = tasks.groupBy("workflow_id").agg(F.min("started_at").alias("_t0"))
    elapsed = seconds_between(F.col("_t0"), F.col("finished_at"))
    late = tasks.join(starts, "workflow_id").where(elapsed >= timeout_seconds)
    last = late.groupBy("workflow_id").agg(F.min("batch").alias("_last"))
    return _cancel_after(tasks, last, timeout_seconds <= 0)


# Attempts ----------------------------------------------------------------------------------------


def final_attempt(attempts: DataFrame) -> DataFrame:
    """State of a task: its first success, else its last attempt."""
    won = is_success(F.col("status"), ("succeeded", "success"))
    order = F.struct(~won, F.when(won, F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.groupBy("task_id").agg(
        F.min_by("status", order).alias("status"),
        F.min_by("attempt", order).alias("attempt"),
        F.count(F.lit(1)).alias("attempts"),
    )


def retry_wait(
    attempts: DataFrame, max_attempts: int = 3, backoff: float = 2.0, multiplier: float = 1.5, http: bool = False
) -> DataFrame:
    """Seconds a task waited between attempts: one backoff after every failed attempt but the last allowed.

    The plain policy waits ``backoff * multiplier^(k - 1)`` after attempt *k*, the HTTP one
    ``min(2^(k - 1), 5)``.
    """
    k = F.col("attempt") - 1
    pause = F.least(F.power(F.lit(2.0), k), F.lit(5.0)) if http else F.power(F.lit(multiplier), k) * backoff
    waits = ~is_success(F.col("status"), ("succeeded", "success")) & (F.col("attempt") < max_attempts)
    return attempts.groupBy("task_id").agg(F.sum(F.when(waits, pause).otherwise(0.0)).alias("wait_seconds"))


def retry_exhausted(attempts: DataFrame, max_attempts: int, retryable: Sequence[str]) -> DataFrame:
    """Tasks whose allowed attempts all ended in a retryable status."""
    folded = attempts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.bool_and(F.col("status").isin(*retryable)).alias("_all"),
        F.max_by("status", "attempt").alias("last_status"),
    )
    return folded.where(F.col("_all") & (F.col("attempts") >= max_attempts)).select(
        "task_id", F.lit("failed").alias("status"), F.lit("retry_exhausted").alias("error"), "attempts", "last_status"
    )


# Action cuts -------------------------------------------------------------------------------------


def action_priority(kind: Column) -> Column:
    out = None
    for name, rank in ACTION_PRIORITY.items():
        out = F.when(kind == name, rank) if out is None else out.when(kind == name, rank)
    return out.otherwise(LAST_PRIORITY)


def limit_actions(actions: DataFrame, keys: Sequence[str], k: int = ACTION_BUDGET) -> DataFrame:
    """First ``k`` actions per key by type priority, then by ``seq``."""
    return top_rows(actions, keys, [action_priority(F.col("type")), F.col("seq")], max(k, 0))


def budget_actions(actions: DataFrame, keys: Sequence[str], budget: int | None = ACTION_BUDGET) -> DataFrame:
    """The ``budget`` actions with most evidence; ties by type, target and content. No budget keeps all."""
    if not budget or budget < 0:
        return actions
    order = [F.col("evidence_count").desc(), F.col("type"), F.coalesce("target", F.lit("")), F.coalesce("content", F.lit("")), F.col("seq")]
    return top_rows(actions, keys, order, budget)


def cap_constraints(constraints: Column, limit: int | None = None) -> Column:
    """The last ``limit`` entries of an array; all without a limit."""
    if limit is None:
        return constraints
    start = F.greatest(F.size(constraints) - limit + 1, F.lit(1))
    return F.slice(constraints, start, F.lit(limit))


def beam_top_k(candidates: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    return top_rows(candidates, keys, [F.col("score").desc(), F.col("seq")], width)


def dedupe_keep_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key; NULL keys are equal."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return picked.select(*keys, "_r.*")


# Step tables -------------------------------------------------------------------------------------


def plateau_detect(trials: DataFrame, key: str, rounds: int = NO_IMPROVE_ROUNDS) -> DataFrame:
    """Per key: the step at which ``rounds`` steps in a row brought no better score, and the best step until then."""
    steps = Window.partitionBy(key).orderBy("step")
    earlier = steps.rowsBetween(Window.unboundedPreceding, -1)
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    marked = trials.select(key, "step", "score").withColumn(
        "_up", F.coalesce(F.col("score") > F.max("score").over(earlier), F.lit(True))
    )
    islands = marked.withColumn("_island", F.sum(F.col("_up").cast("int")).over(upto))
    stale = F.sum((~F.col("_up")).cast("int")).over(Window.partitionBy(key, "_island").orderBy("step"))
    stop = F.min(F.when(F.col("_stale") >= rounds, F.col("step"))).over(Window.partitionBy(key))
    counted = islands.withColumn("_stale", stale).withColumn("stop_step", stop)
    reached = counted.where(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
    best = F.max_by("step", F.struct(F.col("score"), -F.col("step")))
    return reached.groupBy(key).agg(
        F.max("stop_step").alias("stop_step"), best.alias("best_step"), F.max("score").alias("best_score")
    )


def loop_detect(trials: DataFrame, key: str) -> DataFrame:
    """First step whose prompt had been seen in an earlier step; keys without a repeat do not appear."""
    digest = trials.select(key, "step", prompt_hash(F.col("prompt")).alias("prompt_hash"))
    again = top_rows(digest, [key, "prompt_hash"], [F.col("step")], 2)
    firsts = again.groupBy(key, "prompt_hash").agg(F.max("step").alias("_second"), F.count(F.lit(1)).alias("_n"))
    return firsts.where(F.col("_n") == 2).groupBy(key).agg(F.min("_second").alias("loop_step"))


def growth_guard(trials: DataFrame, key: str, growth: float = MAX_PROMPT_GROWTH) -> DataFrame:
    """First step whose prompt is longer than the allowed multiple of the first one; NULL if none is."""
    steps = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sized = trials.select(key, "step", F.length("prompt").alias("_len"))
    marked = sized.withColumn("_over", F.col("_len") > F.floor(F.first("_len").over(steps) * growth))
    return marked.groupBy(key).agg(F.min(F.when(F.col("_over"), F.col("step"))).alias("stop_step"))


def stage_progress(trials: DataFrame, key: str) -> DataFrame:
    """Stage after each step: FORMAT until a step without format issue, then RECALL, then STRICT after two clean steps."""
    steps = Window.partitionBy(key).orderBy("step")
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    clean = ~F.col("has_format_issue")
    marked = trials.select(key, "step", "has_format_issue").withColumn("_clean_rank", F.sum(clean.cast("int")).over(upto))
    # past the first clean step a pair of clean neighbours leads to STRICT
    pair = clean & F.lag(clean).over(steps) & (F.col("_clean_rank") >= 3)
    strict = F.max(F.coalesce(pair, F.lit(False)).cast("int")).over(upto)
    stage = F.when(strict == 1, "STRICT").when(F.col("_clean_rank") >= 1, "RECALL").otherwise("FORMAT")
    staged = marked.withColumn("stage", stage)
    return staged.select(
        key, "step", F.coalesce(F.lag("stage").over(steps), F.lit("FORMAT")).alias("stage_before"), "stage"
    )


def loop_stop(
    cycles: DataFrame,
    key: str,
    no_patch_rounds: int = 1,
    target_failure_rate: float | None = None,
    exit_ratio: float | None = None,
    max_cycles: int = 3,
) -> DataFrame:
    """Cycles up to the first stop, which carries its reason; later cycles drop out."""
    steps = Window.partitionBy(key).orderBy("cycle")
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum((F.col("patches") > 0).cast("int")).over(upto)
    idle = F.sum((F.col("patches") == 0).cast("int")).over(Window.partitionBy(key, "_island").orderBy("cycle"))
    counted = cycles.withColumn("_island", island).withColumn("_idle", idle)
    ratio = F.lit(exit_ratio).cast("double")
    target = F.lit(target_failure_rate).cast("double")
    reason = (
        F.when(F.col("skip_ratio") >= ratio, "skip_ratio")
        .when(F.col("failure_rate") <= target, "target_met")
        .when(F.col("_idle") >= no_patch_rounds, "no_patches")
        .when(F.col("cycle") >= max_cycles, "max_cycles")
    )
    judged = counted.withColumn("stop_reason", reason)
    first = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("cycle"))).over(Window.partitionBy(key))
    kept = judged.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("cycle") <= F.col("_first")))
    return kept.drop("_island", "_idle", "_first")


def slot_freeze(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step until which a slot is frozen after each of its trials, -1 when it is free.

    Two trials without gain after an acceptance freeze the slot for one step, three without any
    acceptance for two.
    """
    steps = Window.partitionBy(*keys).orderBy("step")
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    counted = trials.withColumn("_accepted", F.sum(F.col("accepted").cast("int")).over(upto))
    no_gain = F.sum((~F.col("accepted")).cast("int")).over(Window.partitionBy(*keys, "_accepted").orderBy("step"))
    counted = counted.withColumn("no_gain", no_gain)
    setting = (
        F.when(F.col("accepted"), F.lit(-1))
        .when((F.col("_accepted") > 0) & (F.col("no_gain") >= 2), F.col("step") + 1)
        .when((F.col("_accepted") == 0) & (F.col("no_gain") >= 3), F.col("step") + 2)
    ).cast("long")
    held = F.coalesce(F.last(setting, ignorenulls=True).over(upto), F.lit(-1).cast("long"))
    return counted.withColumn("frozen_until", held).drop("_accepted")


def block_freeze(blocks: DataFrame, trials: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """State of every text block before ``step`` and the block to try next.

    A block is frozen when it states the output form, failed three times since its last gain, or has not
    gained for three steps. Among free blocks those that just gained go first and those that failed last;
    equals take turns.
    """
    block = [*keys, "block_id"]
    tries = Window.partitionBy(*block)
    gained = F.max(F.when(F.col("improved"), F.col("step"))).over(tries)
    past = trials.where(F.col("step") < step).withColumn("_gain", gained)
    fails = past.groupBy(*block).agg(
        F.max("_gain").alias("_gain"),
        F.count_if(~F.col("improved") & (F.col("step") > F.coalesce("_gain", F.lit(-1)))).alias("_fails"),
    )
    gain, failed = F.coalesce("_gain", F.lit(-1)), F.coalesce("_fails", F.lit(0))
    state = join_on(blocks, fails, block).select(
        *block, "block_no", "kind", gain.cast("long").alias("last_improved"), failed.cast("long").alias("fail_count")
    )
    frozen = (
        (F.col("kind") == "output")
        | (F.col("fail_count") >= 3)
        | ((F.col("last_improved") >= 0) & (step - F.col("last_improved") >= 3))
    )
    recent = F.col("last_improved") == step - 1
    priority = F.when(recent, 2).when(F.col("fail_count") > 0, -1).otherwise(0)
    state = state.withColumn("frozen", frozen).withColumn("priority", F.when(~F.col("frozen"), priority))
    group = Window.partitionBy(*keys)
    top = F.col("priority") == F.max("priority").over(group)
    state = state.withColumn("_top", F.coalesce(top, F.lit(False)))
    turn = F.sum(F.col("_top").cast("int")).over(group.orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)) - 1
    tops = F.sum(F.col("_top").cast("int")).over(group)
    return state.withColumn("chosen", F.col("_top") & (turn == F.try_mod(F.lit(step), tops))).drop("_top")


def is_improved(
    score: Column, failed: Column, base_score: Column, base_failed: Column, records: Column, margin: float = 0.02
) -> Column:
    """Fewer failed runs, or a score better by the margin (0.01 with three records or fewer)."""
    needed = F.when(records <= 3, F.least(F.lit(margin), F.lit(0.01))).otherwise(F.lit(margin))
    return ((base_failed > 0) & (failed < base_failed)) | (score >= base_score + needed)


def best_result(trials: DataFrame, key: str) -> DataFrame:
    """Best-scoring trial per key, the earliest of equals."""
    others = [c for c in trials.columns if c != key]
    best = trials.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col("score"), -F.col("step"))).alias("_b"))
    return best.select(key, "_b.*")


def eval_subset(records: DataFrame, keys: Sequence[str], seed: int = 0, minimum: int | None = None, draw: int = EVAL_DRAW) -> DataFrame:
    """All records, or with a ``minimum``: failed runs, plus up to ``draw`` passed ones when fewer than three failed.

    Keys with fewer than ``minimum`` records or without a failure are evaluated in full. The draw of passed
    runs is by seeded digest, and a single passed run is not added.
    """
    if minimum is None:
        return records
    shape = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("passed")).alias("_failed")
    ).withColumn("_passed", F.col("_all") - F.col("_failed"))
    whole = shape.where((F.col("_all") < minimum) | (F.col("_failed") == 0))
    short = shape.where((F.col("_all") >= minimum) & F.col("_failed").between(1, 2) & (F.col("_passed") >= 2))
    cut = shape.where((F.col("_all") >= minimum) & (F.col("_failed") > 0))
    full = records.join(whole.select(*keys), list(keys), "left_semi")
    failed = records.where(~F.col("passed")).join(cut.select(*keys), list(keys), "left_semi")
    passed = records.where("passed").join(short.select(*keys), list(keys), "left_semi")
    extra = top_rows(passed, keys, [draw_order(seed, "run_index"), F.col("run_index")], draw)
    return full.unionByName(failed).unionByName(extra)

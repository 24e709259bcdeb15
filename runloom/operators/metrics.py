"""Run statistics, grades and rates.

Plain aggregates combine before the shuffle, so a hot workflow costs one partial row per task. Exact
percentiles go through :mod:`runloom.operators.ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.ordering import percentiles_of_ranks, ranks_of_counts
from runloom.session import checkpointed

# The percentile points and the grade thresholds of the run statistics.
PERCENTILES = {"p50_execution_time": 0.50, "p95_execution_time": 0.95, "p99_execution_time": 0.99}
GRADES = ("excellent", "good", "fair", "poor")
THRESHOLDS = {"excellent": (2.0, 0.8), "good": (5.0, 0.6), "fair": (10.0, 0.4)}
SUCCESS = ("success", "succeeded")


def is_success(status: Column, success: Sequence[str] = SUCCESS) -> Column:
    return F.coalesce(status.isin(*success), F.lit(False))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on ``keys``. Without keys both sides are one-row aggregates and are laid side by side."""
    if not keys:
        both = left.unionByName(right, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns]).where(F.col(left.columns[0]).isNotNull())
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def percentiles(runs: DataFrame, keys: Sequence[str] = (), value: str = "execution_time") -> DataFrame:
    """p50/p95/p99 with linear interpolation; a group without values gets 0."""
    counts = checkpointed(runs.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    groups = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    return _with_percentiles(groups, counts, keys, value).select(*keys, *PERCENTILES)


def _with_percentiles(groups: DataFrame, counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    ranks = ranks_of_counts(counts.where(F.col(value).isNotNull()).select(*keys, value, "_n"), keys, value)
    joined = join_on(groups, percentiles_of_ranks(ranks, keys, value, PERCENTILES), keys)
    return joined.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)) for p in PERCENTILES})


def run_metrics(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The eleven run statistics per group: counts, rate, times, tokens and cost.

    The runs are read once, into a checkpointed table of the few narrow columns that count; totals come from its rows in their
    order, and the ranks from one row per group and execution time.
    """
    narrow = checkpointed(
        runs.select(*keys, "execution_time", (F.col("status") == "success").alias("_good"), "tokens_used", "cost")
    )
    total = F.count(F.lit(1))
    good = F.count_if("_good")
    base = narrow.groupBy(*keys).agg(
        total.alias("total_executions"),
        good.alias("successful_count"),
        (total - good).alias("failed_count"),
        F.try_divide(good, total).alias("success_rate"),
        F.avg("execution_time").alias("avg_execution_time"),
        F.sum("tokens_used").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.try_divide(F.sum("tokens_used"), total).alias("avg_tokens_per_request"),
    )
    if not keys:
        base = base.where(F.col("total_executions") > 0)
    counts = checkpointed(narrow.groupBy(*keys, "execution_time").agg(F.count(F.lit(1)).alias("_n")))
    return _with_percentiles(base, counts, keys, "execution_time")


def metrics_by_dimensions(runs: DataFrame, dimensions: Sequence[Sequence[str]]) -> DataFrame:
    """Statistics for several groupings in one long table: ``dimension``, ``group_value`` and the metrics.

    Each run is fanned out once per dimension, so the table is scanned and shuffled once.
    """
    labels = []
    for dims in dimensions:
        value = (
            F.concat_ws("/", *[F.coalesce(F.col(d), F.lit("-")) for d in dims]) if dims else F.lit("all")
        )
        labels.append(F.struct(F.lit("+".join(dims) or "all").alias("dimension"), value.alias("group_value")))
    fanned = runs.select(F.inline(F.array(*labels)), "status", "execution_time", "tokens_used", "cost")
    return run_metrics(fanned, ["dimension", "group_value"])


def repr_length(outputs: Column) -> Column:
    """Length of the printed ``{'key': 'value', ...}`` form of a flat string map (exact without escapes)."""
    size = F.size(outputs)
    pairs = F.aggregate(
        F.map_entries(outputs),
        F.lit(0).cast("long"),
        lambda acc, e: acc + F.length(e["key"]) + F.coalesce(F.length(e["value"]), F.lit(2)) + 6,
    )
    return F.when(outputs.isNull() | (size == 0), F.lit(2).cast("long")).otherwise(2 + pairs + 2 * (size - 1))


def token_efficiency(outputs: Column, tokens: Column) -> Column:
    """Printed output length over four characters per token, at most 1; 0 without tokens, null if they are unknown.

    A null value of the map prints as the four letters of ``None``, which have no quotes.
    """
    return F.when(tokens.isNull(), F.lit(None).cast("double")).when(tokens == 0, F.lit(0.0)).otherwise(F.least(repr_length(outputs) / (tokens * 4.0), F.lit(1.0)))


def grade(execution_time: Column, efficiency: Column, thresholds: dict[str, tuple[float, float]]) -> Column:
    out = None
    for name in GRADES[:-1]:
        limit, floor = thresholds[name]
        hit = (execution_time < limit) & (efficiency >= floor)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(GRADES[-1])


def classify_runs(runs: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``efficiency`` and ``grade`` to every run."""
    scored = runs.withColumn("efficiency", token_efficiency(F.col("outputs"), F.col("tokens_used")))
    return scored.withColumn("grade", grade(F.col("execution_time"), F.col("efficiency"), thresholds or THRESHOLDS))


def grade_distribution(graded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per group and grade, grades without runs included."""
    total = F.count(F.lit(1))
    counts = graded.groupBy(*keys).agg(
        total.alias("_total"), *[F.count_if(F.col("grade") == g).alias(g) for g in GRADES]
    )
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("grade"), F.col(g).alias("n")) for g in GRADES]))
    return counts.select(*keys, "_total", rows).select(
        *keys,
        "grade",
        "n",
        F.when(F.col("_total") == 0, 0.0).otherwise(F.try_divide(F.col("n") * 100.0, F.col("_total"))).alias("percent"),
    )


def run_statistics(task_results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per task state, rates over completed tasks, retries and totals per batch.

    Cancelled tasks are not completed, but their time stays in the mean.
    """
    state = F.col("task_status")
    count = {
        "succeeded_tasks": F.count_if(state == "succeeded"),
        "failed_tasks": F.count_if(state == "failed"),
        "timeout_tasks": F.count_if(state == "timeout"),
        "cancelled_tasks": F.count_if(state == "cancelled"),
        "error_tasks": F.count_if(state == "error"),
    }
    completed = F.count_if(state.isin("succeeded", "failed", "timeout", "error"))
    zero = F.lit(0.0)
    return task_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        *[c.alias(name) for name, c in count.items()],
        completed.alias("completed_tasks"),
        F.coalesce(F.try_divide(count["succeeded_tasks"], completed), zero).alias("success_rate"),
        F.coalesce(F.try_divide(F.sum("execution_time"), completed), zero).alias("avg_execution_time"),
        F.sum("execution_time").alias("total_execution_time"),
        F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))).alias("total_retries"),
        F.sum("tokens_used").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with microseconds between two timestamps of either timestamp type."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / F.lit(1e6)


def run_duration(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wall time from the first start to the last finish."""
    span = tasks.groupBy(*keys).agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    return span.select(*keys, seconds_between(F.col("started_at"), F.col("finished_at")).alias("total_duration"))


def failure_rate(workflows: DataFrame, runs: DataFrame, success: Sequence[str] = SUCCESS) -> DataFrame:
    """Share of runs that did not succeed; a workflow without runs counts as 1.0."""
    rates = runs.groupBy("workflow_id").agg(F.avg(F.when(is_success(F.col("status"), success), 0.0).otherwise(1.0)).alias("_rate"))
    return (
        workflows.select("workflow_id")
        .distinct()
        .join(rates, "workflow_id", "left")
        .select("workflow_id", F.coalesce("_rate", F.lit(1.0)).alias("failure_rate"))
    )


def runs_failures(results: DataFrame) -> DataFrame:
    """A run fails when neither its ``result`` text nor its ``status`` says success."""
    text_fails = F.coalesce(F.lower("result") != "success", F.lit(True))
    failed = text_fails & ~is_success(F.col("status"))
    return results.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(failed).alias("failures")
    )


def optimization_stats(samples: DataFrame, references: DataFrame, prompts: DataFrame) -> DataFrame:
    """Run, reference and prompt counts per workflow; ``prompts`` carries ``skipped`` and ``needs_change``."""
    ran = samples.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~is_success(F.col("status"))).alias("failures")
    )
    refs = references.groupBy("workflow_id").agg(F.count_if(F.length("reference_text") > 0).alias("_refs"))
    change = F.col("needs_change") & ~F.col("skipped")
    asked = prompts.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(change).alias("_change"),
        F.count_if(F.col("skipped")).alias("_skipped"),
    )
    zero = F.lit(0).cast("long")
    total, need = F.coalesce("_total", zero), F.coalesce("_change", zero)
    return (
        ran.join(refs, "workflow_id", "left")
        .join(asked, "workflow_id", "left")
        .select(
            "workflow_id",
            "runs",
            "failures",
            F.coalesce("_refs", zero).alias("reference_texts"),
            total.alias("prompts_total"),
            need.alias("prompts_need_change"),
            (total - need).alias("prompts_no_change"),
            F.coalesce("_skipped", zero).alias("prompts_skip_intent"),
            F.try_divide(total - need, total).alias("prompts_skip_ratio"),
        )
    )


def judge_pass_rate(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass share and failed-run count per candidate; the failed runs are ``verdicts`` where not ``passed``."""
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("score"),
        F.count_if(~F.col("passed")).alias("failed_runs"),
    )


def failure_signature(
    failures: DataFrame, keys: Sequence[str], text: str, prefix: int | None = None, digits: int | None = None
) -> DataFrame:
    """The distinct hashes that make up a group's signature, one row each.

    Joined in order by ``|`` they are the signature; as rows a group with countless distinct failures
    stays spread over tasks. Whole texts and whole digests count, unless the caller names a shorter ``prefix``
    or fewer ``digits`` (80 and 8 for short signatures).
    """
    flat = F.btrim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    part = F.sha2(flat if prefix is None else F.left(flat, F.lit(prefix)), 256)
    part = part if digits is None else F.left(part, F.lit(digits))
    return failures.select(*keys, part.alias("part")).distinct()


def score_trial(issues: Column, actions: Column) -> Column:
    return F.lit(100.0) - issues * 10.0 - actions * 2.0


def error_rate_step(issues: Column, expected_outputs: Column) -> Column:
    return F.least(F.lit(1.0), issues / F.greatest(expected_outputs, F.lit(1)))

"""Issues of workflow runs against their references.

Found are heads, one row per issue: ``key, issue_seq, kind, severity, message, evidence_set, evidence_run``. Evidence is a
set that issues of a workflow share (all its runs, the failed, the slow ones), or one run, or nothing; the sets are
bitmaps (:func:`evidence_sets`), so heads and sets grow with issues and runs, not with their product.
:func:`explicit_evidence` gives one row per issue and run in their place, with NULL where there is none; the ``issue_*``
functions do so for their kind. ``issue_seq`` orders the issues of a key.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import evidence as E
from runloom.operators.metrics import SUCCESS, is_success
from runloom.operators.texts import constraint_coverage, constraint_hits, with_similarity
from runloom.session import checkpointed

# Defaults of a reference.
SIMILARITY_THRESHOLD = 0.72
MAX_FAILURE_RATE = 0.2
# Order of the issue kinds within a workflow.
KINDS = (
    "insufficient_data", "high_failure_rate", "low_similarity", "constraint_missing", "latency_exceeded",
    "llm_output_mismatch", "llm_judge_unreliable",
)
# Evidence that issues of a workflow share.
ALL, FAILED, SLOW = "all", "failed", "slow"
SHOWN = ("issue_seq", "kind", "severity", "message")


def _sequence(number: int, ordinal: Column | None = None) -> Column:
    """Number of the kind, then any long that is not negative."""
    base = F.lit(Decimal(number << 63)).cast("decimal(20,0)")
    return (base + F.coalesce(ordinal, F.lit(0)).cast("decimal(19,0)") if ordinal is not None else base).cast("decimal(38,0)")


def _head(kind: str, severity: Column | str, message: Column | str, shared: str | None = None, run: Column | None = None, ordinal: Column | None = None) -> list[Column]:
    text = [F.lit(x) if isinstance(x, str) else x for x in (severity, message)]
    return [
        _sequence(KINDS.index(kind), ordinal).alias("issue_seq"),
        F.lit(kind).alias("kind"),
        text[0].alias("severity"),
        text[1].alias("message"),
        F.lit(shared).cast("string").alias("evidence_set"),
        (F.lit(None) if run is None else run).cast("long").alias("evidence_run"),
    ]


def _by_run(heads: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    return heads.drop("evidence_set", "evidence_run").join(runs.select(key, F.col("index").cast("long").alias("evidence_run")), key)


def _is_failed(success) -> Column:
    return ~is_success(F.col("status"), success)


def insufficient_data_heads(specs: DataFrame, samples: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Referenced workflows that have no runs at all."""
    idle = specs.select(key).distinct().join(samples.select(key).distinct(), key, "left_anti")
    return idle.select(key, *_head("insufficient_data", "low", "No execution samples available"))


def issue_insufficient_data(specs: DataFrame, samples: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Referenced workflows that have no runs at all."""
    return insufficient_data_heads(specs, samples, key).drop("evidence_set")


def failure_rate_heads(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", success=SUCCESS) -> DataFrame:
    """Workflows whose share of failed runs exceeds the limit; evidence are the failed runs.

    A workflow without reference is held to the default limit.
    """
    rates = samples.groupBy(key).agg(F.avg(_is_failed(success).cast("double")).alias("_rate"))
    limits = rates.join(specs.select(key, "max_failure_rate"), key, "left")
    limited = limits.withColumn("_limit", F.coalesce("max_failure_rate", F.lit(MAX_FAILURE_RATE)))
    over = limited.where(F.col("_rate") > F.col("_limit"))
    message = F.format_string("Failure rate %.2f exceeds threshold %.2f", "_rate", "_limit")
    return over.select(key, *_head("high_failure_rate", "high", message, FAILED))


def issue_high_failure_rate(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", success=SUCCESS) -> DataFrame:
    """Workflows whose share of failed runs exceeds the limit, a row for each failed run."""
    return _by_run(failure_rate_heads(samples, specs, key, success), samples.where(_is_failed(success)), key)


def similarity_scores(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", shown: str | None = None) -> DataFrame:
    """Similarity ``_sim`` of each output to the first expected output, and the limit; ``shown`` tells a sample, ``key`` unless named."""
    limit = F.coalesce("similarity_threshold", F.lit(SIMILARITY_THRESHOLD))
    baselines = specs.where(F.size("expected_outputs") > 0).select(
        key, F.element_at("expected_outputs", 1).alias("_base"), limit.alias("_limit")
    )
    column = shown or key
    spoken = samples.where(T.non_empty(F.col("output_text"))).select(*dict.fromkeys((key, column)), "output_text")
    return with_similarity(spoken.join(baselines, key), "_base", "output_text", "_sim").select(column, "_sim", "_limit")


def low_similarity_heads(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", scores: DataFrame | None = None) -> DataFrame:
    """Workflows whose outputs resemble the first expected output too little; evidence are all runs.

    ``scores`` are the rows of :func:`similarity_scores`, if they are there already: the outputs are not read then.
    """
    means = (similarity_scores(samples, specs, key) if scores is None else scores).groupBy(key).agg(F.avg("_sim").alias("_mean"), F.max("_limit").alias("_limit"))
    low = means.where(F.col("_mean") < F.col("_limit"))
    severity = F.when(F.col("_mean") > F.col("_limit") * 0.7, "medium").otherwise("high")
    message = F.format_string("Average similarity %.2f below threshold %.2f", "_mean", "_limit")
    return low.select(key, *_head("low_similarity", severity, message, ALL))


def issue_low_similarity(samples: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Workflows whose outputs resemble the first expected output too little, a row for each run."""
    return _by_run(low_similarity_heads(samples, specs, key), samples, key)


def constraint_missing_heads(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", hits: DataFrame | None = None) -> DataFrame:
    """Constraints that no output of the workflow shows; evidence are all runs."""
    absent = constraint_coverage(samples, specs, key, hits).where(F.col("found") == 0)
    message = F.concat(F.lit("Constraint not observed in outputs: "), F.col("constraint"))
    return absent.select(key, *_head("constraint_missing", "high", message, ALL, ordinal=F.col("constraint_no")))


def issue_constraint_missing(samples: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Constraints that no output of the workflow shows, a row for each constraint and run."""
    return _by_run(constraint_missing_heads(samples, specs, key), samples, key)


def _slow_runs(samples: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    limited = samples.select(key, "index", "duration_seconds").join(
        specs.where(F.col("max_latency_seconds").isNotNull()).select(key, "max_latency_seconds"), key
    )
    return limited.where(F.coalesce("duration_seconds", F.lit(0.0)) > F.col("max_latency_seconds"))


def latency_heads(samples: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Workflows with runs longer than the limit; the message counts them, evidence are these runs."""
    counts = _slow_runs(samples, specs, key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("max_latency_seconds").alias("_limit"))
    message = F.format_string("Latency exceeded %.1fs in %d runs", "_limit", "_n")
    return counts.select(key, *_head("latency_exceeded", "medium", message, SLOW))


def issue_latency_exceeded(samples: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Runs longer than the limit; the message counts them and the evidence names them."""
    return _by_run(latency_heads(samples, specs, key), _slow_runs(samples, specs, key), key)


def output_mismatch_heads(judged: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Judge answers that fail, an issue for each; ``judged`` comes from ``parse_judge_verdict`` and has ``index``."""
    failed = judged.where(~F.col("passed"))
    return failed.select(key, *_head("llm_output_mismatch", F.col("severity"), F.col("message"), run=F.col("index"), ordinal=F.col("index")))


def issue_output_mismatch(judged: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Judge answers that fail; ``judged`` comes from ``parse_judge_verdict`` and has ``index``."""
    return output_mismatch_heads(judged, key).drop("evidence_set")


def judge_unreliable_heads(judged: DataFrame, calls: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Workflows where judge calls failed and no answer reported a mismatch; ``calls`` has ``raw``, NULL on failure.

    Evidence are all runs.
    """
    broken = calls.where(F.col("raw").isNull()).select(key).distinct()
    mismatched = judged.where(~F.col("passed")).select(key).distinct()
    alone = broken.join(mismatched, key, "left_anti")
    return alone.select(key, *_head("llm_judge_unreliable", "medium", "judge failed or unavailable, reference check incomplete", ALL))


def issue_judge_unreliable(samples: DataFrame, judged: DataFrame, calls: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Workflows where judge calls failed and no answer reported a mismatch, a row for each run."""
    return _by_run(judge_unreliable_heads(judged, calls, key), samples, key)


def _counted_heads(samples: DataFrame, specs: DataFrame, key: str, success=SUCCESS) -> DataFrame:
    """Issues that counts of a workflow's runs decide, from one pass over the runs: none at all, failures, slow ones."""
    limits = specs.select(key, F.col("max_failure_rate").alias("_rate_limit"), F.col("max_latency_seconds").alias("_limit"))
    referenced = limits.withColumn("_referenced", F.lit(True))
    slow = F.coalesce("duration_seconds", F.lit(0.0)) > F.col("_limit")
    timed = samples.select(key, "status", "duration_seconds").join(limits.select(key, "_limit"), key, "left")
    counts = timed.groupBy(key).agg(F.avg(_is_failed(success).cast("double")).alias("_rate"), F.count_if(slow).alias("_slow"))
    every = counts.join(referenced, key, "full").withColumn("_most", F.coalesce("_rate_limit", F.lit(MAX_FAILURE_RATE)))
    head = lambda *facts, **more: F.struct(*_head(*facts, **more))
    branches = [
        F.when(F.col("_rate").isNull() & F.col("_referenced"), head("insufficient_data", "low", "No execution samples available")),
        F.when(
            F.col("_rate") > F.col("_most"), head("high_failure_rate", "high", F.format_string("Failure rate %.2f exceeds threshold %.2f", "_rate", "_most"), FAILED)
        ),
        F.when(F.col("_slow") > 0, head("latency_exceeded", "medium", F.format_string("Latency exceeded %.1fs in %d runs", "_limit", "_slow"), SLOW)),
    ]
    return every.select(key, F.inline(F.array_compact(F.array(*branches))))


def detect_heads(
    samples: DataFrame,
    specs: DataFrame,
    judged: DataFrame | None = None,
    calls: DataFrame | None = None,
    key: str = "workflow_id",
    similarity: bool = True,
    measured: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All issues of all workflows, one row each; ``specs`` has one row per key.

    What counts of runs decide comes from one pass over them; texts are read for the constraints, and for the similarity, unless
    both are ``measured`` already: similarity scores and constraint hits.
    """
    scores, hits = measured or (None, None)
    branches = [_counted_heads(samples, specs, key), constraint_missing_heads(samples, specs, key, hits)]
    if similarity:
        branches.append(low_similarity_heads(samples, specs, key, scores))
    if judged is not None:
        branches.append(output_mismatch_heads(judged, key))
        if calls is not None:
            branches.append(judge_unreliable_heads(judged, calls, key))
    return reduce(DataFrame.unionByName, branches)


def evidence_sets(samples: DataFrame, specs: DataFrame, heads: DataFrame, key: str = "workflow_id", success=SUCCESS) -> DataFrame:
    """Bitmaps ``key, evidence_set, bucket, bits`` of the sets that heads name, in one pass over the runs.

    A run takes part in at most three sets, and a set has a row per 32,768 run numbers: linear in the runs.
    """
    limits = specs.select(key, F.col("max_latency_seconds").alias("_limit"))
    limited = samples.select(key, "index", "status", "duration_seconds").join(limits, key, "left")
    slow = F.coalesce("duration_seconds", F.lit(0.0)) > F.col("_limit")
    names = F.array_compact(F.array(F.lit(ALL), F.when(_is_failed(success), FAILED), F.when(slow, SLOW)))
    member = limited.select(key, F.col("index").cast("long").alias("evidence_run"), F.explode(names).alias("evidence_set"))
    named = heads.where(F.col("evidence_set").isNotNull()).select(key, "evidence_set").distinct()
    return E.bitmaps(member.join(named, [key, "evidence_set"], "left_semi"), [key, "evidence_set"])


def explicit_evidence(heads: DataFrame, sets: DataFrame, key: str = "workflow_id", columns: tuple[str, ...] = SHOWN) -> DataFrame:
    """``key``, ``columns`` and ``evidence_run``: a row for each head and run of its evidence, NULL where it has none."""
    named = heads.where(F.col("evidence_set").isNotNull()).drop("evidence_run")
    spread = named.join(E.runs(sets, [key, "evidence_set"]), [key, "evidence_set"])
    alone = heads.where(F.col("evidence_set").isNull())
    return spread.select(key, *columns, "evidence_run").unionByName(alone.select(key, *columns, "evidence_run"))


def with_evidence_count(heads: DataFrame, sets: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Heads with the number of runs behind each, from one small row per set."""
    counted = heads.join(E.sizes(sets, [key, "evidence_set"]), [key, "evidence_set"], "left")
    single = F.when(F.col("evidence_set").isNull(), F.col("evidence_run").isNotNull().cast("long")).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("evidence_count", F.coalesce("evidence_count", single)).select(*heads.columns, "evidence_count")


def detect_issues(
    samples: DataFrame, specs: DataFrame, judged: DataFrame | None = None, calls: DataFrame | None = None, key: str = "workflow_id"
) -> DataFrame:
    """All issues of all workflows with a row per run of their evidence."""
    heads = checkpointed(detect_heads(samples, specs, judged, calls, key))
    return explicit_evidence(heads, evidence_sets(samples, specs, heads, key), key)


def measured_outputs(answered: DataFrame, trials: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the texts of single outputs tell, in narrow rows by ``trial_id``: similarity scores and constraint hits.

    ``answered`` has ``trial_id, output_text`` and may be a part of all outputs; ``trials`` has ``trial_id, workflow_id`` of all.
    References are looked up by their workflow and not once a trial.
    """
    outputs = answered.select("trial_id", "output_text").join(trials.select("trial_id", "workflow_id"), "trial_id")
    scores = similarity_scores(outputs, specs, shown="trial_id")
    return scores, constraint_hits(outputs, specs, shown=["trial_id"]).drop("constraint")


def analyze_single_output(
    trials: DataFrame, specs: DataFrame, judged: DataFrame | None = None, measured: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Issues of single outputs: one sample per ``trial_id``, checked against the workflow's reference.

    ``trials`` has ``trial_id, workflow_id, status, output_text, duration_seconds``; ``output_text`` is not read if the outputs
    are ``measured``, by :func:`measured_outputs`.
    """
    samples = trials.withColumn("index", F.lit(1).cast("long"))
    per_trial = trials.select("trial_id", "workflow_id").join(specs, "workflow_id").drop("workflow_id")
    measured = measured or measured_outputs(trials, trials, specs)
    heads = detect_heads(samples.drop("workflow_id"), per_trial, judged, key="trial_id", measured=measured)
    # the only run there is shows every issue, unless there is nothing to show
    run = F.coalesce("evidence_run", F.when(F.col("evidence_set").isNotNull(), F.lit(1).cast("long")))
    return heads.withColumn("evidence_run", run).drop("evidence_set")


def issue_headers(issues: DataFrame, key: str = "workflow_id") -> DataFrame:
    """One row per issue with the number of runs that show it."""
    return issues.groupBy(key, "issue_seq", "kind", "severity", "message").agg(
        F.count("evidence_run").alias("evidence_count")
    )


def fail_signal(issues: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Signals of the issues as rows ``bucket, item, item_seq``.

    Buckets: ``tags`` (kinds), ``missing_fields``, ``format_errors``, ``constraint_gaps`` and
    ``semantic_gaps`` by words of the message. Constraints that no gap mentions are added to the gaps.
    """
    heads = issues.select(key, "issue_seq", "kind", "message").distinct()
    low = F.lower("message")

    def has(*words: str) -> Column:
        return reduce(Column.__or__, [low.contains(w) for w in words])

    buckets = F.array_compact(
        F.array(
            F.lit("tags"),
            F.when(has("missing", "not observed"), "missing_fields"),
            F.when(has("format", "json"), "format_errors"),
            F.when(has("constraint"), "constraint_gaps"),
            F.when(has("similarity", "mismatch"), "semantic_gaps"),
        )
    )
    spread = heads.select(key, "issue_seq", "kind", "message", F.explode(buckets).alias("bucket"))
    item = F.when(F.col("bucket") == "tags", F.lower("kind")).otherwise(F.col("message"))
    listed = spread.select(key, "bucket", item.alias("item"), "issue_seq")
    rows = listed.groupBy(key, "bucket", "item").agg(F.min("issue_seq").alias("item_seq"))
    wanted = specs.select(
        key, F.filter(F.array_distinct("constraints"), T.non_empty).alias("_wanted")
    ).join(heads.select(key).distinct(), key, "left_semi")
    mentions = (
        rows.where(F.col("bucket") == "constraint_gaps")
        .join(wanted, key)
        .select(key, F.explode(F.filter("_wanted", lambda c: F.contains(F.lower("item"), F.lower(c)))).alias("_c"))
        .distinct()
    )
    open_ones = wanted.select(key, F.posexplode("_wanted").alias("_no", "_c")).join(mentions, [key, "_c"], "left_anti")
    ensured = open_ones.select(
        key,
        F.lit("constraint_gaps").alias("bucket"),
        F.concat(F.lit("Ensure constraint is satisfied: "), F.col("_c")).alias("item"),
        _sequence(len(KINDS), F.col("_no")).alias("item_seq"),
    )
    return rows.unionByName(ensured)

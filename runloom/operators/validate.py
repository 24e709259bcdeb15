"""Checks that label bad rows instead of failing the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first check that holds, NULL when none does."""
    out = None
    for bad, name in checks:
        hit = F.coalesce(bad, F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def run_reason() -> Column:
    return first_reason(
        [
            (F.coalesce(F.col("workflow_id"), F.lit("")) == "", "workflow_id is required"),
            (F.coalesce(F.col("execution_id"), F.lit("")) == "", "execution_id is required"),
            (F.col("execution_time") < 0, "execution_time must be non-negative"),
            (F.col("tokens_used") < 0, "tokens_used must be non-negative"),
            (F.col("cost") < 0, "cost must be non-negative"),
        ]
    )


def validate_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; rejected rows carry the first failing rule in ``reason``."""
    judged = runs.withColumn("reason", run_reason())
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def validate_thresholds(thresholds: DataFrame, key: str) -> DataFrame:
    """First rule that each set of grade thresholds breaks, NULL for a sound set.

    ``thresholds`` has one row per set and grade: ``grade``, ``execution_time``, ``token_efficiency``.
    """
    grades = ("excellent", "good", "fair")
    folded = thresholds.groupBy(key).agg(
        *[F.count_if(F.col("grade") == g).alias(f"{g}_n") for g in grades],
        *[
            F.max(F.when(F.col("grade") == g, F.col(c))).alias(f"{g}_{c}")
            for g in grades
            for c in ("execution_time", "token_efficiency")
        ],
    )
    checks: list[tuple[Column, str]] = []
    for g in grades:
        time, share = F.col(f"{g}_execution_time"), F.col(f"{g}_token_efficiency")
        checks += [
            (F.col(f"{g}_n") == 0, f"missing threshold for {g}"),
            (time.isNull(), f"missing execution_time for {g}"),
            (share.isNull(), f"missing token_efficiency for {g}"),
            (time <= 0, f"execution_time for {g} must be positive"),
            ((share <= 0) | (share > 1), f"token_efficiency for {g} must be in (0, 1]"),
        ]
    a, b, c = (F.col(f"{g}_execution_time") for g in grades)
    checks.append((~((a < b) & (b < c)), "execution_time must rise from excellent to fair"))
    a, b, c = (F.col(f"{g}_token_efficiency") for g in grades)
    checks.append((~((a > b) & (b > c)), "token_efficiency must fall from excellent to fair"))
    return folded.select(key, first_reason(checks).alias("reason"))


def validate_plan_refs(plan: DataFrame, catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    """Unresolved references of a plan: ``catalog_id``, ``kind`` (workflow or dataset) and the missing ``ref``."""
    known = catalog.select(F.col("id").alias("catalog_id")).distinct()
    workflows = plan.select("catalog_id").distinct().join(known, "catalog_id", "left_anti")
    refs = plan.select("catalog_id", F.explode("dataset_refs").alias("ref")).distinct()
    missing = refs.join(datasets.select(F.col("dataset").alias("ref")).distinct(), "ref", "left_anti")
    return workflows.select("catalog_id", F.lit("workflow").alias("kind"), F.col("catalog_id").alias("ref")).unionByName(
        missing.select("catalog_id", F.lit("dataset").alias("kind"), "ref")
    )


def validate_variants(variants: DataFrame) -> DataFrame:
    """Duplicate variant ids and fallbacks that the same workflow does not define."""
    per_id = variants.groupBy("workflow_id", "variant_id").agg(F.count(F.lit(1)).alias("_n"))
    doubled = per_id.where(F.col("_n") > 1).select(
        "workflow_id", F.col("variant_id").alias("ref"), F.lit("duplicate variant").alias("problem")
    )
    wanted = variants.where(F.length("fallback_variant") > 0).select("workflow_id", F.col("fallback_variant").alias("ref")).distinct()
    defined = per_id.select("workflow_id", F.col("variant_id").alias("ref"))
    missing = wanted.join(defined, ["workflow_id", "ref"], "left_anti")
    return doubled.unionByName(missing.select("workflow_id", "ref", F.lit("unknown fallback").alias("problem")))


def validate_input_multiplicity(inputs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Check per workflow that list inputs, and a list reference, share one length.

    ``inputs`` has ``workflow_id, is_list, values``; ``references`` has ``workflow_id, is_list, values``.
    Workflows with scalar inputs only always pass.
    """
    size = F.when(F.col("is_list"), F.size("values"))
    lengths = inputs.groupBy("workflow_id").agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    if references is None:
        lengths = lengths.withColumn("_ref", F.lit(None).cast("int"))
    else:
        wanted = references.where("is_list").groupBy("workflow_id").agg(F.max(F.size("values")).alias("_ref"))
        lengths = lengths.join(wanted, "workflow_id", "left")
    reason = F.when(F.col("_low") < F.col("_high"), "list inputs differ in length").when(
        F.col("_low").isNotNull() & (F.col("_ref") != F.col("_low")), "reference length differs"
    )
    return lengths.select("workflow_id", F.col("_low").alias("expected_length"), reason.alias("reason"))

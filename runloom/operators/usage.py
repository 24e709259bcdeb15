"""Token usage, cost and prompt versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Price in dollars per 1000 input and output tokens.
PRICES = {
    "gpt-4-turbo-preview": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-sonnet": (0.003, 0.015),
}
MAJOR, MINOR = 15.0, 5.0  # fixed values: improvements from which a version steps up
VARIABLE = r"\{\{\s*[#@$]?\s*([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*)\s*#?\s*\}\}"


def usage_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a request in dollars, NULL for a model without a price."""
    cost = None
    for name, (price_in, price_out) in PRICES.items():
        spent = input_tokens / 1000.0 * price_in + output_tokens / 1000.0 * price_out
        cost = F.when(model == name, spent) if cost is None else cost.when(model == name, spent)
    return cost


def usage_stats(requests: DataFrame) -> DataFrame:
    """Requests, tokens, cost and mean latency in one row."""
    return requests.agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.avg("latency_ms").alias("average_latency_ms"),
    )


def daily_cost(requests: DataFrame, as_of: Column) -> DataFrame:
    """Cost of the 24 hours up to ``as_of``."""
    recent = (F.col("ts") > as_of - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= as_of)
    return requests.where(recent).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("daily_cost"))


def recent_requests(requests: DataFrame, n: int, order: str) -> DataFrame:
    """The last ``n`` requests, newest first."""
    return requests.orderBy(F.col("ts").desc(), F.col(order).desc()).limit(n)


def version_bump(changes: DataFrame, key: str) -> DataFrame:
    """Version after each change of a prompt, from 1.0.0; the first row of a prompt is its first version."""
    steps = Window.partitionBy(key).orderBy("step")
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.row_number().over(steps) > 1, F.coalesce("improvement", F.lit(0.0)))
    staged = changes.withColumn("_gain", gain)
    major = F.count_if(F.col("_gain") >= MAJOR).over(upto)
    staged = staged.withColumn("_major", major)
    minor = F.count_if((F.col("_gain") >= MINOR) & (F.col("_gain") < MAJOR))
    staged = staged.withColumn("_minor", minor.over(Window.partitionBy(key, "_major").orderBy("step")))
    patch = F.count_if(F.col("_gain") < MINOR).over(Window.partitionBy(key, "_major", "_minor").orderBy("step"))
    version = F.concat_ws(".", (F.col("_major") + 1).cast("string"), F.col("_minor").cast("string"), patch.cast("string"))
    return staged.withColumn("version", version).drop("_gain", "_major", "_minor")


def prompt_variables(text: Column) -> Column:
    """Distinct variable names inside ``{{ }}``, in order; a leading ``#``, ``@`` or ``$`` is not part of the name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(1)))


def missing_variables(text: Column, wanted: Column) -> Column:
    return F.array_except(wanted, prompt_variables(text))

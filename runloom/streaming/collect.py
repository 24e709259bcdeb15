"""Collecting runs from a stream and keeping statistics per workflow up to date."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.validate import run_reason

#: Size of a quantile sketch: some 20 kB for a workflow, however many runs it has.
SKETCH_K = 800
#: Within so much of its rank a percentile lies with a probability of 99 %, by the sketch's published error, 2.296 / k ** 0.9723.
RANK_ERROR = 2.296 / SKETCH_K**0.9723


def partial_statistics(runs: DataFrame) -> DataFrame:
    """Mergeable statistics per workflow: counts, sums and a quantile sketch of the times; duplicates count, invalid runs do not."""
    valid = runs.where(run_reason().isNull())
    return valid.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("status") == "success").alias("successful_count"),
        F.sum("tokens_used").alias("total_tokens"),
        F.sum("execution_time").alias("time_sum"),
        F.count("execution_time").alias("time_count"),
        F.kll_sketch_agg_double(F.col("execution_time").cast("double"), F.lit(SKETCH_K)).alias("time_sketch"),
    )


def merged_statistics(*parts: DataFrame) -> DataFrame:
    """The statistics of all runs behind ``parts``, in any order and grouping."""
    sums = ("total_executions", "successful_count", "total_tokens", "time_sum", "time_count")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("workflow_id").agg(*(F.sum(c).alias(c) for c in sums), F.kll_merge_agg_double("time_sketch").alias("time_sketch"))


def readable_statistics(stats: DataFrame) -> DataFrame:
    """Means and percentiles in place of sums and sketches.

    Percentiles are approximate, as their names say: exact ones need all values again and come from the batch operators.
    """
    quantile = F.when(F.col("time_count") > 0, F.kll_sketch_get_quantile_double("time_sketch", F.lit(0.95)))
    return stats.select(
        "workflow_id", "total_executions", "successful_count", "total_tokens",
        F.try_divide("time_sum", "time_count").alias("avg_execution_time"),
        quantile.alias("p95_execution_time_approx"),
    )


class Snapshots:
    """The folders of written statistics, one a batch, of which the newest whole one counts."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, number: int) -> str:
        return f"{self.target}/batch={number}"

    def _found(self) -> list[int]:
        if not self._files.exists(self._path(self.target)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.target))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def newest(self) -> int | None:
        whole = [n for n in self._found() if self._files.exists(self._path(f"{self.folder(n)}/_SUCCESS"))]
        return whole[-1] if whole else None

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(number))

    def keep_only(self, number: int) -> None:
        for other in self._found():
            if other != number:
                self._files.delete(self._path(self.folder(other)), True)


def stream_collect(
    runs: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Start the query that brings the statistics in ``target`` up to date after every batch.

    A batch is aggregated on its own and merged with the snapshot before it, so the work goes with the batch and the
    number of workflows, and the stream has no state but the snapshot. The merged snapshot is written beside the old one, which
    then goes: one is left on disk. A batch that is repeated after a failure finds either the snapshot before it or,
    if that has been replaced already, its own, and is not counted twice. ``on_batch`` gets the statistics so far.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = Snapshots(batch.sparkSession, target)
        before = kept.newest()
        if before is None or before < number:
            parts = [partial_statistics(batch)] + ([kept.read(before)] if before is not None else [])
            merged_statistics(*parts).write.mode("overwrite").parquet(kept.folder(number))
        kept.keep_only(max(number, before or 0))
        if on_batch is not None:
            on_batch(readable_statistics(kept.read(max(number, before or 0))), number)

    return runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def collected(spark: SparkSession, target: str) -> DataFrame:
    """The mergeable statistics written last; those of several targets can be merged."""
    kept = Snapshots(spark, target)
    newest = kept.newest()
    if newest is None:
        raise FileNotFoundError(f"no statistics in {target}")
    return kept.read(newest)


def snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The statistics written last."""
    return readable_statistics(collected(spark, target))

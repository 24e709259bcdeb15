"""Tables in few large files with an index: a read of one key opens the files that can hold it, however many keys there are.

A folder per key makes as many small files as keys. Here rows are dealt out in ranges of the key and written in its order, and a
table beside them says which keys each file holds. A key with very many rows spans several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import checkpointed

#: Rows of a file, about; wide rows want fewer.
ROWS_PER_FILE = 1_000_000


def write_store(rows: DataFrame, folder: str, key: str, order: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``rows`` in ranges of ``key``, then of ``order``, and the index; rows without a key come first."""
    stored = checkpointed(rows)
    files = max(1, -(-stored.count() // rows_per_file))
    columns = [key, *order]
    dealt = stored.repartitionByRange(files, *columns).sortWithinPartitions(*columns)
    dealt.write.mode("overwrite").parquet(f"{folder}/rows")
    written = rows.sparkSession.read.parquet(f"{folder}/rows")
    index = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("without_key")
    )
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")


def store_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: ``path``, the ``first`` and ``last`` key, ``rows``, and how many of them are ``without_key``."""
    return spark.read.parquet(f"{folder}/index")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


def read_key(spark: SparkSession, folder: str, key: str, value) -> DataFrame:
    """The rows of one key, from the files whose range holds it; only their names come to the driver."""
    index = store_index(spark, folder)
    wanted = F.col("without_key") > 0 if value is None else F.lit(value).between(F.col("first"), F.col("last"))
    paths = [r["path"] for r in index.where(wanted).select("path").toLocalIterator()]
    every = read_store(spark, folder)
    if not paths:
        return every.where("false")
    return spark.read.schema(every.schema).parquet(*paths).where(F.col(key).eqNullSafe(F.lit(value)))

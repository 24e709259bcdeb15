"""Helpers of the operators: written tables in the shared folder, free column names, exact byte constants."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import session
from runloom.session import stored

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words and is stripped from lines.
WHITE = " \t\n\x0b\x0c\r"
#: A word in Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that goes to Python: whole texts, so far fewer than Spark's default for narrow rows.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Prepare ``spark`` for work in Python: the package on the workers, batches that a worker's memory holds."""
    session.ship_package(spark)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever the caller's extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["WHITE", "WORD", "fresh", "lower_ascii", "partitions", "ship_package", "stored", "table"]

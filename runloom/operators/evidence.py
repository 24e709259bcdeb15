"""Sets of run numbers as bitmaps: a row per set and 32,768 numbers, whatever the number of issues or actions that name the set.

A table of sets has the columns that identify a set, ``bucket`` and ``bits``. Numbers that count the runs of a workflow fill
their bitmaps; a set of a single run is better kept as that number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as Spark's bitmap functions fix it.
WIDTH = 32768


def bitmaps(rows: DataFrame, keys: Sequence[str], run: str = "evidence_run") -> DataFrame:
    """The distinct runs of each set; rows without a run make no set."""
    known = rows.where(F.col(run).isNotNull())
    placed = known.select(*keys, F.bitmap_bucket_number(run).alias("bucket"), F.bitmap_bit_position(run).alias("_bit"))
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def united(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of all sets that share ``keys``."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("evidence_count"))


def _byte(bits: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, place + 1, F.lit(1))), 16, 10).cast("int")


def runs(sets: DataFrame, keys: Sequence[str], run: str = "evidence_run") -> DataFrame:
    """A row per run of each set, in place of its bitmaps."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WIDTH // 8 - 1)), lambda i: F.substring(F.col("bits"), i + 1, F.lit(1)) != F.lit(b"\x00"))
    filled = sets.select(*keys, "bucket", F.explode(F.transform(places, lambda i: F.struct(i.alias("i"), _byte(F.col("bits"), i).alias("b")))).alias("_p"))
    bit = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(F.col("_p.b"), b) == 1)
    spread = filled.select(*keys, "bucket", (F.col("_p.i") * 8).alias("_at"), F.explode(bit).alias("_b"))
    position = (F.col("_at") + F.col("_b")).cast("long")
    # numbers from 1 on count up in their bucket, others down
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * WIDTH + position + 1).otherwise(F.col("bucket") * WIDTH - position)
    return spread.select(*keys, number.alias(run))

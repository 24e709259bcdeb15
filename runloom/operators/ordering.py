"""Positions, running totals and exact percentiles that do not need a whole group in one task.

A window over ``workflow_id`` alone would sort all rows of a hot workflow in one task. Here the order
axis is cut into chunks of roughly equal row counts, the ordered work runs per (key, chunk), and a small
table of chunk totals supplies the offset of every chunk. The cut points come from approximate quantiles
but only decide where a chunk ends, so the result is exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from runloom.session import checkpointed

_AXIS, _CHUNK = "_axis", "_chunk"


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Seconds of a timestamp of either type as a double, whatever the session time zone."""
    col = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):  # a cast could fold over at a clock change
        day = F.unix_date(F.to_date(col)).cast("double")
        second = F.extract(F.lit("SECOND"), col).cast("double")
        return day * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + second
    return F.unix_micros(col) / F.lit(1e6)


def _axis(df: DataFrame, column: str) -> Column:
    """Order column as a double, seconds for timestamps; NULL stays NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return epoch_seconds(df, column)
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"leading order column {column} must be numeric or a timestamp, not {kind.simpleString()}")
    return F.col(column).cast("double")


def _told_apart(kind: T.DataType) -> float:
    """Below this size, different values of ``kind`` are different doubles."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return float(1 << 32)  # seconds, with six decimals
    return 0.0 if isinstance(kind, T.DecimalType) else float(1 << 53)


def _attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, whose one row per key is found for null keys too."""
    renamed = other.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, reduce(and_, on)).drop(*[f"_key_{i}" for i in range(len(keys))])


def chunk_count(df: DataFrame) -> int:
    """As many chunks as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucketed(df: DataFrame, axis: Column, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the number of the interval between ``cuts`` that ``axis`` falls into: NULL the first, not-a-number the last."""
    splits = [float("-inf"), *sorted(set(cuts) - {float("-inf"), float("inf")}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    framed = df.withColumn(_AXIS, F.coalesce(axis, F.lit(float("-inf"))))
    return Bucketizer(splits=splits, inputCol=_AXIS, outputCol=name, handleInvalid="keep").transform(framed).drop(_AXIS)


def _spread(df: DataFrame) -> Column:
    """Hash of a row, which tells apart rows that no order column does."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def _cuts_up_to(cuts: Column, row: Column, most: int) -> Column:
    """How many of the sorted ``cuts``, of which there are ``most`` at most, are not above ``row``: a binary search."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, above = at["low"] < at["high"], F.get(cuts, middle) <= row
        return F.struct(F.when(open_ & above, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(at["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, halve, lambda at: at["low"])


def with_chunks(df: DataFrame, order: str | Sequence[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``, non-decreasing in ``order``, with about equal row counts over all keys.

    Cut points of the leading column come from approximate quantiles. A leading value that many rows share, or NULL, is cut
    further at points over all other order columns, of any type that can be ordered, taken from a sample of some twenty rows a
    chunk; rows that are equal in all of them are told apart by a hash of the row. Only copies of a whole row stay together.
    """
    lead, *others = [order] if isinstance(order, str) else order
    wanted = chunks or chunk_count(df)
    axis, missing = _axis(df, lead), F.col(lead).isNull()
    shares = F.array(*(F.lit(i / wanted) for i in range(1, wanted)))
    facts = df.agg(
        F.percentile_approx(axis, shares, F.lit(4 * wanted)).alias("cuts"), F.count_if(missing).alias("missing"), F.count(F.lit(1)).alias("rows")
    ).first()
    cuts = facts["cuts"] or []
    limit = _told_apart(df.schema[lead].dataType)
    hot = sorted({v for v, w in zip(cuts, cuts[1:]) if v == w and abs(v) < limit})
    absent = facts["missing"] * wanted > facts["rows"]
    # a hot value gets an interval of its own, which the other columns then cut
    out = _bucketed(df, axis, [*cuts, *(math.nextafter(v, math.inf) for v in hot)], _CHUNK)
    if not hot and not absent:
        return out
    number = F.array_position(F.array(*map(F.lit, hot)), axis) if hot else F.lit(0).cast("long")
    crowd = F.when(missing, F.lit(-1 if absent else 0).cast("long")).otherwise(number)
    row = F.struct(*others, _spread(df).alias("_row"))
    some = int(min(1.0, 20 * wanted / facts["rows"]) * (1 << 30))
    sample = df.where((crowd != 0) & (F.pmod(_spread(df), F.lit(1 << 30)) < some)).select(crowd.alias("_crowd"), row.alias("_cut")).distinct()
    pieces = F.ceil(F.size("_s") / 20).cast("int")
    points = F.transform(F.slice(F.sequence(F.lit(0), pieces), F.lit(2), pieces - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / pieces).cast("int")))
    sampled = sample.groupBy("_crowd").agg(F.sort_array(F.collect_list("_cut")).alias("_s"))
    # a row for each hot value, of which there are fewer than chunks; their cuts are some as many as chunks
    crowds = checkpointed(sampled.select(F.col("_crowd").alias("_of"), points.alias("_cuts")))
    placed = out.withColumn("_crowd", crowd).join(F.broadcast(crowds), F.col("_crowd") == F.col("_of"), "left")
    part = F.when(F.col("_cuts").isNotNull(), _cuts_up_to(F.col("_cuts"), row, 4 * wanted) / (F.size("_cuts") + 1)).otherwise(0.0)
    start = F.when(F.col("_crowd") == -1, F.lit(-1.0)).otherwise(F.col(_CHUNK))
    return placed.withColumn(_CHUNK, start + part).drop("_crowd", "_of", "_cuts")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "index", chunks: int | None = None
) -> DataFrame:
    """1-based position per key in ``order``; ``order[0]`` must be numeric or a timestamp."""
    keys = list(keys)
    chunked = with_chunks(df, order, chunks)
    sizes = chunked.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, _CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    return (
        chunked.withColumn("_pos", F.row_number().over(within))
        .transform(_attach, bases, [*keys, _CHUNK])
        .withColumn(name, (F.col("_base") + F.col("_pos")).cast("long"))
        .drop("_base", "_pos", _CHUNK)
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, chunks: int | None = None) -> DataFrame:
    """One row per (key, value): the 0-based rank range ``lo``..``hi`` it covers and the group size ``n``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return ranks_of_counts(checkpointed(counts), keys, value, chunks)


def ranks_of_counts(counts: DataFrame, keys: Sequence[str], value: str, chunks: int | None = None) -> DataFrame:
    """``value_ranks`` of values that are counted already: ``counts`` has a row per key and value, with ``_n``.

    It should be a stored or checkpointed table, as it is read several times.
    """
    keys = list(keys)
    chunked = with_chunks(counts, value, chunks)
    sizes = chunked.groupBy(*keys, _CHUNK).agg(F.sum("_n").alias("_size"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        *keys,
        _CHUNK,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
        F.sum("_size").over(per_key).alias("n"),
    )
    running = Window.partitionBy(*keys, _CHUNK).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_upto", F.sum("_n").over(running))
        .transform(_attach, bases, [*keys, _CHUNK])
        .select(
            *keys,
            value,
            "n",
            (F.col("_base") + F.col("_upto") - F.col("_n")).alias("lo"),
            (F.col("_base") + F.col("_upto") - 1).alias("hi"),
        )
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], chunks: int | None = None
) -> DataFrame:
    """Linearly interpolated percentiles at ``p * (n - 1)``, one row per key."""
    return percentiles_of_ranks(value_ranks(df, keys, value, chunks), keys, value, points)


def percentiles_of_ranks(ranks: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    picks = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("lo") <= rank) & (rank <= F.col("hi"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{side}"))
    folded = ranks.groupBy(*keys).agg(F.max("n").alias("_n"), *picks)
    out = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_n") - 1)
        weight = at - F.floor(at)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low * (1 - weight) + high * weight).alias(name))
    return folded.select(*keys, *out)


def with_session_start(df: DataFrame, keys: Sequence[str], time: str, order: str, pause: float, chunks: int | None = None) -> DataFrame:
    """Add ``_session``: the time at which the row's session began, sessions being parted by ``pause`` or more.

    The previous row of a chunk's first row, and the session that runs into a chunk, come from small
    tables of one row per key and chunk.
    """
    keys = list(keys)
    chunked = with_chunks(df, [time, order], chunks)
    per_key = Window.partitionBy(*keys).orderBy(_CHUNK)
    ends = chunked.groupBy(*keys, _CHUNK).agg(F.max(time).alias("_end"))
    lasts = ends.select(*keys, _CHUNK, F.lag("_end").over(per_key).alias("_before"))
    within = Window.partitionBy(*keys, _CHUNK).orderBy(time, order)
    previous = F.coalesce(F.lag(time).over(within), F.col("_before"))
    marked = (
        chunked.transform(_attach, lasts, [*keys, _CHUNK])
        .withColumn("_start", F.when(previous.isNull() | (F.col(time) - previous >= pause), F.col(time)))
        .drop("_before")
    )
    starts = marked.groupBy(*keys, _CHUNK).agg(F.max("_start").alias("_last"))
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select(*keys, _CHUNK, F.max("_last").over(earlier).alias("_carried"))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_own", F.last("_start", ignorenulls=True).over(upto))
        .transform(_attach, carried, [*keys, _CHUNK])
        .withColumn("_session", F.coalesce("_own", "_carried"))
        .drop("_own", "_carried", "_start", _CHUNK)
    )

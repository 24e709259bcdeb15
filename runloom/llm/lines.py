"""Line dedup: hashes of lines range-partitioned and sorted by document and position, read as streams."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import WHITE, fresh, lower_ascii, partitions, ship_package, stored

_DROP, _OPEN, _EDGE = 0, 1, 2
_EVENT = "kind int, h1 long, h2 long, doc_id long, twin long, position int, n long"


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, twin, position) of every line whose key has ``min_chars`` code points; 128 bits identify a key."""
    lines = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line")
    )
    keys = lines.select("doc_id", "twin", "position", lower_ascii(F.btrim("line", F.lit(WHITE))).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "twin", "position"
    )


def _streams(min_docs: int):
    def run(batches):
        key, edge, started = None, False, False
        keeper = last = docs = None
        wait: list = []
        names = ["kind", "h1", "h2", "doc_id", "twin", "position", "n"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def table(rows):
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out = []
            for h1, h2, doc, twin, position in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (h1, h2):
                    if edge:
                        out.append((_EDGE, *key, keeper, None, None, docs))
                    key, edge, started = (h1, h2), not started, True
                    keeper = last = doc
                    docs, wait = 1, []
                elif doc != last:
                    docs, last = docs + 1, doc
                if edge:
                    out.append((_OPEN, h1, h2, doc, twin, position, None))
                elif doc == keeper:
                    continue
                elif docs < min_docs:
                    wait.append((doc, twin, position))
                else:
                    out.extend((_DROP, None, None, *w, None) for w in wait)
                    wait = []
                    out.append((_DROP, None, None, doc, twin, position, None))
            yield table(out)
        if started:
            yield table([(_OPEN, *key, *w, None) for w in wait] + [(_EDGE, *key, keeper, None, None, docs)])

    return run


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            keep = np.ones(-(-(max(places) + 1) // 8) * 8, np.uint8)
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("twin"), pa.array(maps, pa.binary())], ["doc_id", "twin", "keep"]
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document that loses lines: (doc_id, twin, keep), ``keep`` a zlib-compressed bitmap of its lines.

    Bits past the end of the bitmap are 1; ``twin`` is the hash of the text, which tells rows that share a doc_id apart.
    Lines are dealt out in ranges of (key, document), largest document first, so that a line that a third of all documents
    share spreads over many tasks. A task streams its range with the state of one key. What it cannot know is whether its
    first key began, or its last key goes on, in another task: such rows stay open, and each task reports its two
    edge keys, from which a table of at most two rows per task, which is broadcast, decides them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    dealt = line_hashes(docs, min_chars).repartitionByRange(partitions(spark), *order)
    events = stored(dealt.sortWithinPartitions(*order, "position").mapInArrow(_streams(min_docs), _EVENT), "line-events")
    edges = (
        events.where(F.col("kind") == _EDGE)
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    opened = events.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> keeper")
    spots = ["doc_id", "twin", "position"]
    drops = events.where(F.col("kind") == _DROP).select(spots).unionByName(opened.select(spots))
    per_doc = drops.groupBy("doc_id", "twin").agg(F.collect_set("position").alias("places"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, twin long, keep binary")


def _kept_lines(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    texts, dropped = [], []
    for t, k in zip(text, keep):
        if k is None:
            texts.append(None)
            dropped.append(None)
            continue
        away = set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8)) == 0).tolist())
        lines = t.split("\n")
        texts.append("\n".join(line for i, line in enumerate(lines) if i not in away))
        dropped.append(len(away))
    return pd.DataFrame({"text": texts, "dropped": dropped})


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without repeated lines; with ``counts``, also the numbers of lines before and of lines dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``min_chars`` code points or more
    that ``min_docs`` documents hold stay in the largest doc_id that has them, all their lines, and go everywhere else.

    * null or empty text: one empty line, nothing dropped, the text as it is; * null doc_id: the row passes unchanged and is
    no document that holds a line; * rows that share a doc_id are parts of one document; * all other columns pass.
    """
    lines, dropped, twin, keep, result, key = fresh(docs, "n_lines_", "n_dropped_", "twin_", "keep_", "result_", "doc_")
    maps = keep_bitmaps(docs, min_chars, min_docs).toDF(key, twin, keep)
    own = docs.withColumn(twin, F.xxhash64("text"))
    joined = own.join(maps.hint("shuffle_hash"), (own["doc_id"] == maps[key]) & (own[twin] == maps[twin]), "left")
    joined = joined.select(*(own[c] for c in docs.columns), maps[keep])
    # only texts that lose lines go to Python
    out = joined.withColumn(result, F.pandas_udf(_kept_lines, "struct<text string, dropped long>")(F.when(F.col(keep).isNotNull(), F.col("text")), F.col(keep)))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = out.withColumn(lines, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    out = out.withColumn(dropped, F.coalesce(F.col(f"{result}.dropped"), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.coalesce(F.col(f"{result}.text"), F.col("text")))
    named = [F.col(lines).alias(counts[0]), F.col(dropped).alias(counts[1])] if counts else []
    return out.select(*docs.columns, *named)

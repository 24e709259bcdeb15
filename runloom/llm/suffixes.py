"""Repeated passages by suffixes: a difference cover's sample is ranked first, then the suffixes it leaves, bucket by bucket."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored
from runloom.llm.words import PIECE, hashes, prefix_sums

#: Bytes of text of a block, the unit of work, and keys of a bucket, the unit of sorting.
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(v, D): any two numbers have d < v so that both plus d lie in D modulo v (Colbourn and Ling: |D| = 6 r + 4)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)


def _blocks(block_bytes: int):
    """Texts of a partition in blocks: a row holds the texts' bytes, compressed, with ids, row numbers and lengths."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, data, held = [], [], [], 0

        def block():
            nonlocal number, ids, sizes, data, held
            raw = b"".join(data)
            packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
            row = [[(part << 32) + number], [ids], [sizes], [len(raw)], [packed]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            number, ids, sizes, data, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["block", "ids", "sizes", "bytes", "data"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py().encode() if text.is_valid else b""
                if held and held + len(raw) > block_bytes:
                    yield block()
                ids.append(doc)
                sizes.append(len(raw))
                data.append(raw)
                held += len(raw)
        if ids:
            yield block()

    return run


_BLOCK = "block long, ids array<long>, sizes array<long>, bytes long, data binary"
_KEYS = "bucket int, block long, keys binary, often binary"
_MARKS = "block long, bucket int, marks binary"


class _Text:
    """A block's bytes and, for each of its places, the end of the text it lies in."""

    def __init__(self, sizes, size: int, data: bytes):
        raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(np.asarray(sizes, np.int64))
        self.starts = self.ends - np.asarray(sizes, np.int64)

    def sample(self, v: int, cover: np.ndarray, length: int) -> np.ndarray:
        """Places of the difference cover from which ``length`` bytes of the same text follow."""
        found = []
        for start, end in zip(self.starts, self.ends):
            if end - start >= length:
                places = (np.arange(start, end - length + 1, v)[:, None] + cover).ravel()
                found.append(places[places <= end - length])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def keys(self, places: np.ndarray, length: int) -> np.ndarray:
        """64-bit hashes of the ``length`` bytes from each place, a stretch of the block at a time."""
        out = np.empty(len(places), np.uint64)
        for low in range(0, len(self.data), PIECE):
            a, b = np.searchsorted(places, [low, low + PIECE])
            if a < b:
                sums = prefix_sums(self.data[low : low + PIECE + length])
                at = places[a:b] - low
                out[a:b] = hashes(sums, at, at + length)
        return out

    def candidates(self, sample: np.ndarray, v: int, length: int) -> np.ndarray:
        """Places whose suffix has a repeated sample place less than ``v`` further on, and ``length`` bytes of its text."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        owner = np.searchsorted(self.ends, sample, "right")
        low = np.maximum(sample - v + 1, self.starts[owner])
        high = np.minimum(sample, self.ends[owner] - length)
        fine = high >= low
        np.add.at(edge, low[fine], 1)
        np.add.at(edge, high[fine] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _bounds(buckets: int) -> np.ndarray:
    """The least key of each bucket but the first."""
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


def _bucketed(block: int, keys: np.ndarray, buckets: int):
    """A block's distinct keys in order, cut by bucket, with a bit for each that the block has more than once."""
    ranked = np.sort(keys)
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    one = ranked[first]
    often = np.diff(np.append(np.flatnonzero(first), len(ranked))) > 1
    cuts = np.searchsorted(one, _bounds(buckets))
    rows = [(b, block, part.tobytes(), np.packbits(o).tobytes()) for b, (part, o) in enumerate(zip(np.split(one, cuts), np.split(often, cuts))) if len(part)]
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "block", "keys", "often"])


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Sort one bucket: for each block's keys, a bit for those that it has twice or that another block has too."""
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    tied = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    marks = np.empty(len(every), bool)
    marks[order] = tied
    parts = np.split(marks, np.cumsum(sizes)[:-1])
    often = [np.unpackbits(np.frombuffer(o.as_py(), np.uint8))[:n].astype(bool) for o, n in zip(table.column("often"), sizes)]
    packed = [np.packbits(p | o).tobytes() for p, o in zip(parts, often)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "marks": pa.array(packed, pa.binary())})


def _merged(keys: np.ndarray, buckets: int, marks: list[tuple[int, bytes]]) -> np.ndarray:
    """For each key of a block, whether it is repeated: what the buckets have answered, put together."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    answer, one = dict(marks), ranked[first]
    sizes = np.diff([0, *np.searchsorted(one, _bounds(buckets)), len(one)])
    flags = [np.unpackbits(np.frombuffer(answer[b], np.uint8), count=int(n)) for b, n in enumerate(sizes) if n]
    found = np.zeros(len(keys), bool)
    if flags:
        found[order] = np.concatenate(flags).astype(bool)[np.cumsum(first) - 1]
    return found


def _marks(row) -> list[tuple[int, bytes]]:
    return [(m["bucket"], m["marks"]) for m in row or []]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _sample_keys(v, cover, length, buckets):
    def run(batches):
        for row in _rows(batches):
            text = _Text(row["sizes"], row["bytes"], row["data"])
            yield _bucketed(row["block"], text.keys(text.sample(v, cover, length), length), buckets)

    return run


def _suffix_places(text: _Text, row, v, cover, short, length, buckets) -> np.ndarray:
    sample = text.sample(v, cover, short)
    return text.candidates(sample[_merged(text.keys(sample, short), buckets, _marks(row["found"]))], v, length)


def _suffix_keys(v, cover, short, length, buckets, finer):
    def run(batches):
        for row in _rows(batches):
            text = _Text(row["sizes"], row["bytes"], row["data"])
            places = _suffix_places(text, row, v, cover, short, length, buckets)
            yield _bucketed(row["block"], text.keys(places, length), finer)

    return run


def _removals(v, cover, short, length, buckets, finer):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for row in _rows(batches):
            text = _Text(row["sizes"], row["bytes"], row["data"])
            places = _suffix_places(text, row, v, cover, short, length, buckets)
            repeated = places[_merged(text.keys(places, length), finer, _marks(row["again"]))]
            edge = np.zeros(len(text.data) + 1, np.int32)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out = []
            for doc, start, end in zip(row["ids"], text.starts, text.ends):
                away = gone[start:end]
                spans = int(away[:1].sum() + (away[1:] & ~away[:-1]).sum())
                kept = text.data[start:end][~away].tobytes()
                out.append((doc, int(end - start), int(away.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, r: int = 1, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): texts without bytes in a ``length``-byte string that starts twice.

    Suffixes are sorted as far as ``length`` bytes, in buckets that are sorted one at a time:

    1. Texts are put into blocks, written once. The sample, the places of a difference cover of period v, is ranked by its
       first length - v + 1 bytes. Wherever two suffixes agree on ``length`` bytes, a sample place follows both within v.
    2. A suffix none of whose sample places is tied is alone and drops out. The others' first ``length`` bytes are hashed whole:
       the sample is only a filter, and no rank of it enters a key.
    3. Suffixes that are tied cover the bytes that go.

    Ties are not resolved by ranks of the sample: blocks get back one bit a sample key, tied or not, and a rank would be some
    bytes a key more to shuffle. A rank is a 64-bit hash, of which only equality is used, never confirmed on the bytes;
    ordering by it deals suffixes out evenly. A block sends each key
    once, so that a passage of a third of all texts weighs as many keys as there are blocks; a bucket holds about
    ``bucket_keys`` keys whatever the input, a block about ``block_bytes`` bytes or one text.

    * null text: no bytes; * texts shorter than ``length`` lose nothing; * repeated rows repeat each other; * null doc_id: as any
    other; * extra columns are ignored; * an empty table gives no row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    v, cover = difference_cover(r)
    short = length - v + 1
    if short < 8:
        raise ValueError("length must exceed the period of the difference cover")
    blocks = stored(docs.select("doc_id", "text").mapInArrow(_blocks(block_bytes), _BLOCK), "suffix-blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-int(total) * len(cover) // (v * bucket_keys)))

    def answers(keys: DataFrame, name: str, column: str) -> DataFrame:
        marks = keys.groupBy("bucket").applyInArrow(_sort_bucket, _MARKS)
        grouped = marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "marks")).alias(column))
        return stored(grouped.withColumnRenamed("block", "b"), name)

    found = answers(blocks.select("block", "sizes", "bytes", "data").mapInArrow(_sample_keys(v, cover, short, buckets), _KEYS), "suffix-sample", "found")
    known = blocks.join(found, F.col("block") == F.col("b"), "left").drop("b")
    # at most every place is tied; buckets of the second pass stay as large as those of the first if about a twelfth is
    finer = buckets
    tied = known.select("block", "sizes", "bytes", "data", "found").mapInArrow(_suffix_keys(v, cover, short, length, buckets, finer), _KEYS)
    again = answers(tied, "suffix-tied", "again")
    both = known.join(again, F.col("block") == F.col("b"), "left").drop("b")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return both.mapInArrow(_removals(v, cover, short, length, buckets, finer), schema)

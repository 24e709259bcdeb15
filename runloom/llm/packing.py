"""Best-fit packing of tokenized documents by minimum bin slack."""

from __future__ import annotations

import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks of a text (what spaces and line ends separate) whose ids a Python worker remembers.
_REMEMBER = 300_000
#: Letters below this code point are spelled here; words with others go to the tokenizer as they are.
_LATIN = 0x250
_TAIL = ".,;:!?%&#*$|<>\"()-"


class _Encoder:
    """Ids of texts as little-endian bytes.

    The tokenizer's pre-tokens never reach over white space, so a text's ids are those of its chunks between spaces and line
    ends, one after the other. A chunk of letters and then ASCII punctuation is two pre-tokens, case does not matter. Chunks
    and their parts recur; only new ones go to the tokenizer.
    """

    made: dict[str, "_Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # each Latin letter in lower case and as the model spells it
        letters = [c for c in map(chr, range(_LATIN)) if c.isalpha() and len(c.lower()) == 1]
        self.letters = {c: spelled.pre_tokenize_str(c.lower())[0][0] for c in letters if c.lower().isalpha()}
        self.chunks: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> "_Encoder":
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    @staticmethod
    def _split(chunk: str) -> tuple[str, str]:
        stem = chunk.rstrip(_TAIL)
        if not stem.isalpha():
            return chunk, ""
        if stem.isascii():
            return stem.lower(), chunk[len(stem) :]
        # a letter may end in a mark in lower case, which then joins the punctuation
        return (stem, chunk[len(stem) :]) if stem.lower().isalpha() else (chunk, "")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.chunks
        new = {c: self._split(c) for c in {c for chunks in split for c in chunks if c not in known}}
        parts = self.parts
        fresh = list({p for pair in new.values() for p in pair if p not in parts})
        got, rest, letters, model = {}, [], self.letters, self.model
        for p in fresh:
            if p.isalpha() and is_normalized("NFC", p):
                try:
                    word = "".join([letters[c] for c in p])
                except KeyError:
                    rest.append(p)
                    continue
                # one pre-token of letters: the tokenizer's own model alone gives its ids
                got[p] = array("I", [t.id for t in model.tokenize(word)]).tobytes()
            else:
                rest.append(p)
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        got.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, made))
        extra = {c: (got.get(a) or parts.get(a, b"")) + (got.get(b) or parts.get(b, b"")) for c, (a, b) in new.items()}
        # what is met first is most frequent: once the tables are full, later finds serve these texts only
        if len(parts) < _REMEMBER:
            parts.update(got)
        full = len(known) >= _REMEMBER
        known.update(extra)
        ids = [b"".join([known[c] for c in chunks]) for chunks in split]
        if full:
            for c in extra:
                del known[c]
        return ids


def _batched(texts: list, size: int):
    """Runs of texts of about ``size`` characters; a longer text stands alone."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def _tokenize(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _Encoder.of(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows, at = [], 0
            for texts in _batched(batch.column("text").to_pylist(), 1 << 19):
                for data in encoder.encode(texts):
                    data += tail
                    for piece, first in enumerate(range(0, len(data) // 4, capacity)):
                        part = data[4 * first : 4 * (first + capacity)]
                        rows.append((ids[at], piece, first, len(part) // 4, zlib.crc32(part)))
                    at += 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut every ``capacity`` ids."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, capacity, end_id), _PIECES)


def fullest(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """The fullest bin that ``lengths`` (length, how many there are; longest first) can make, with the longest in it.

    Subset sums are the bits of an integer: each length shifts them, as often as it is there, in powers of two. The
    search ends with the first full sum; the bits after each step lead back to the lengths of the best one.
    """
    longest = lengths[0][0]
    room = capacity - longest
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i, (length, there) in enumerate(lengths):
        left = min(there - (i == 0), room // length) if length <= room else 0
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts`` (length -> pieces): how often, and (length, how many) of one bin, until nothing is left.

    Minimum bin slack with the longest length left in every bin. A combination is repeated as long as there are pieces for
    it, so the work depends on the lengths, of which there are ``capacity`` at most, and not on the number of pieces.
    """
    left, plan = dict(counts), []
    while left:
        bin_ = fullest(sorted(left.items(), reverse=True), capacity)
        times = min(left[length] // many for length, many in bin_)
        plan.append((times, bin_))
        for length, many in bin_:
            left[length] -= many * times
            if not left[length]:
                del left[length]
    return plan


def _places(plan) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, pieces per bin, first sequence, offset of the first piece), by rank."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, bin_ in plan:
        offset = 0
        for length, many in bin_:
            rows.setdefault(length, []).append((rank.get(length, 0), many, sequence, offset))
            rank[length] = rank.get(length, 0) + many * times
            offset += length * many
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _assign(shared):
    def run(batches):
        places = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                table = places[int(one)]
                first, many, start, begin = table[np.searchsorted(table[:, 0], rank[at], "right") - 1].T
                sequence[at] = start + (rank[at] - first) // many
                offset[at] = begin + (rank[at] - first) % many * one
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048, chunk_rows: int = 50_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, in as few sequences as it can.

    Only the number of pieces of each length, ``capacity`` rows at most, goes to the driver, and the plan it comes back as
    is bounded by ``capacity`` too. Pieces of a length are ranked in chunks of about ``chunk_rows`` pieces by a hash of the
    document, so that a length that a third of all pieces have is spread out; a rank tells the sequence and the place.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    chunks = F.greatest(F.lit(16), F.ceil(F.lit(pieces.count() / chunk_rows))).cast("long")
    keyed = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), chunks))
    sizes = keyed.groupBy("length", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(sizes.withColumn("before", F.coalesce(before, F.lit(0))), "pack-chunks")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(starts.drop("count"), ["length", "chunk"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    return rows.mapInArrow(_assign(shared), f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece of every text: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * null or empty text: the end id alone; * null doc_id: packed like others; * repeated rows: each is packed; * an empty table
    gives no row; * a text of any length is cut, whole, into pieces; * extra columns are ignored.
    """
    return pack(stored(tokenized_pieces(docs, tokenizer, capacity, end_id), "pack-pieces"), capacity)

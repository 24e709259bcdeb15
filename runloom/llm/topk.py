"""Exact top-k inner products by a uniform threshold in three phases over lists of partial scores."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import partitions, ship_package, stored

#: Queries of a block, which a task holds, and rows of a part, which it reads as a stream.
QUERY_BLOCK, PART_ROWS = 1 << 16, 1 << 20
#: Queries whose partial scores with a batch of rows are held at once.
_AT_ONCE = 2048
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "query_id long, vec_id long, score long"


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector of finite numbers."""
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors, as whole numbers in double precision; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _totals(rows: np.ndarray, query: np.ndarray, exact: bool) -> list[int]:
    """Whole inner products; in Python's integers where doubles could round, and no further than a long goes."""
    if exact:
        return (rows @ query).astype(np.int64).tolist()
    q = [int(v) for v in query]
    return [max(_LEAST, min(_MOST, sum(int(a) * b for a, b in zip(row, q)))) for row in rows]


class _Search:
    """A block of queries against a stream of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cutoff: np.ndarray | None, k: int, lists: int):
        self.ids, self.vectors, self.cutoff, self.k, self.lists = ids, vectors, cutoff, k, lists
        self.best: list[list] = [[] for _ in ids]
        self.kept = [[np.zeros(0, np.float32)] * len(ids) for _ in range(lists)]
        self.floor = np.full((lists, len(ids)), -np.inf, np.float32)

    def _push(self, i: int, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool) -> None:
        at = at[ids[at] != self.ids[i]]
        heap = self.best[i]
        for score, vec in zip(_totals(rows[at], self.vectors[i], exact), ids[at].tolist()):
            item = (score, -vec)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        width = max(rows.shape[1], self.vectors.shape[1])
        rows, self.vectors = _wide(rows, width), _wide(self.vectors, width)
        largest = [float(np.abs(x).max(initial=0)) for x in (rows, self.vectors)]
        exact = largest[0] * largest[1] * width < 1 << 53
        cuts = [width * g // self.lists for g in range(self.lists + 1)]
        # partial scores are screened in single precision; what rounding can add to or take from a sum of width products
        sums = np.sqrt((rows * rows).sum(axis=1).max(initial=0)) if max(largest) < 1e15 else np.inf
        small = rows.astype(np.float32) if sums < np.inf else None
        for low in range(0, len(self.ids), _AT_ONCE):
            queries = self.vectors[low : low + _AT_ONCE]
            if small is None:
                for i in range(len(queries)):
                    self._push(low + i, np.arange(len(ids)), ids, rows, exact)
                continue
            room = np.sqrt((queries * queries).sum(axis=1)) * sums * (width + 2) * 2.0**-23
            single = queries.astype(np.float32)
            partial = [single[:, a:b] @ small[:, a:b].T for a, b in zip(cuts, cuts[1:])]
            (self._gather if self.cutoff is None else self._collect)(low, partial, room, ids, rows, exact)

    def _gather(self, low: int, partial: list, room: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool) -> None:
        """First phase: the rows at the top of any list, with their whole scores."""
        tops: dict[int, list] = {}
        for g, p in enumerate(partial):
            hit = p > self.floor[g, low : low + len(p), None]
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                at = np.flatnonzero(hit[i])
                if len(at) > self.k:
                    at = at[np.argpartition(-p[i, at], self.k - 1)[: self.k]]
                tops.setdefault(i, []).append(at)
                kept = np.sort(np.concatenate([self.kept[g][low + i], p[i, at]]))[-self.k :]
                self.kept[g][low + i] = kept
                if len(kept) == self.k:
                    self.floor[g, low + i] = kept[0]
        for i, at in tops.items():
            self._push(low + i, np.unique(np.concatenate(at)), ids, rows, exact)

    def _collect(self, low: int, partial: list, room: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool) -> None:
        """Second and third phase: entries of at least cutoff / lists in a list, whole scores of those that can reach the cutoff."""
        cutoff = self.cutoff[low : low + len(room)] - room
        each = (cutoff / self.lists)[:, None].astype(np.float32)
        each = np.nextafter(each, np.float32(-np.inf))
        most = np.zeros(partial[0].shape, np.float32)
        enough = np.zeros(most.shape, bool)
        for p in partial:
            enough |= p >= each
            most += np.maximum(p, each)
        enough &= most >= np.nextafter(cutoff.astype(np.float32), np.float32(-np.inf))[:, None] - room[:, None]
        for i in np.flatnonzero(enough.any(axis=1)).tolist():
            self._push(low + i, np.flatnonzero(enough[i]), ids, rows, exact)

    def found(self) -> pa.RecordBatch:
        rows = [(q, -vec, score) for q, heap in zip(self.ids.tolist(), self.best) for score, vec in heap]
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _phase(k: int, lists: int, scale: int, cut: bool):
    def run(batches):
        ids, vectors, cutoffs, search = [], [], [], None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            split = int(np.searchsorted(kind, 1))
            for a, b in ((0, split), (split, len(kind))):
                if a == b:
                    continue
                own, whole = batch.column("vec_id").slice(a, b - a).to_numpy(), _whole(batch.column("vec").slice(a, b - a), scale)
                if not a and split:  # the queries of the cell come first
                    ids.append(own)
                    vectors.append(whole)
                    cutoffs.append(batch.column("cutoff").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.float64))
                    continue
                if not ids:
                    return
                if search is None:
                    width = max(v.shape[1] for v in vectors)
                    cutoff = np.concatenate(cutoffs)
                    search = _Search(np.concatenate(ids), np.concatenate([_wide(v, width) for v in vectors]), np.where(np.isnan(cutoff), -np.inf, cutoff) if cut else None, k, lists)
                search.meet(own, whole)
        if search is not None:
            yield search.found()

    return run


def top_inner_products(embeddings: DataFrame, queries: Column | None = None, k: int = 10, lists: int = 2, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product of whole numbers floor(scale * x), exactly.

    A vector's components are cut into ``lists`` stretches; a row's score is the sum of its partial scores in as many lists. Rows
    lie in parts, each with its stretch of every list, and blocks of queries meet the parts in three phases:

    1. each part gathers, for each query and list, the rows at the top of the list, and their whole scores; the k-th best over
       all parts is a score that k rows reach, so a safe cutoff;
    2. the cutoff goes out with the queries. A row that reaches it has at least cutoff / lists in some list. Each part collects
       those entries and drops rows that cannot reach the cutoff with less than that share in the lists that they are not in;
    3. the whole scores of the rest are resolved, and a part returns at most ``k`` rows a query.

    Partial scores are screened in single precision with room for its rounding; whole scores are exact, in integers of any size
    where doubles would round. Shuffled are each row once per ``QUERY_BLOCK`` queries and each query once per part; results are
    ``k`` a query and part. Parts are dealt out by row number, so neither a repeated vector nor a repeated id gathers anywhere.

    * null vec_id, null vector, null, infinite or not-a-number components: no part taken; * a shorter vector ends in zeros, an
    empty one scores 0; * scores beyond a long stay at its limit; * fewer than ``k`` other rows: all; * ties: the smaller vec_id;
    * repeated vec_ids: a query is answered once (its smallest vector), rows with its own id are not its candidates, and each row of
    another id is one; * an empty table gives no row; * extra columns are ignored.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = stored(usable_rows(embeddings), "topk-rows")
    chosen = rows.where(queries if queries is not None else F.col("vec_id") % 100 == 0)
    asked = stored(chosen.groupBy("vec_id").agg(F.min("vec").alias("vec")), "topk-queries")
    parts = max(partitions(spark), -(-rows.count() // PART_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("part", (F.monotonically_increasing_id() % parts).cast("int"))
    there = dealt.select(F.lit(1).alias("kind"), "vec_id", "vec", F.lit(None).cast("long").alias("cutoff"), "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def phase(questions: DataFrame, cut: bool) -> DataFrame:
        asking = questions.select(F.lit(0).alias("kind"), "vec_id", "vec", "cutoff", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"))
        cells = asking.unionByName(there).repartitionById(parts * blocks, (F.col("part") * blocks + F.col("block")).cast("int"))
        return cells.sortWithinPartitions("kind").select("kind", "vec_id", "vec", "cutoff").mapInArrow(_phase(k, lists, scale, cut), _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = phase(asked.withColumn("cutoff", F.lit(None).cast("long")), False)
    top = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoff = top.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    informed = stored(asked.join(cutoff, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vec", "cutoff"), "topk-cutoffs")
    found = phase(informed, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

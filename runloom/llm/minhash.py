"""MinHash near-dedup: bottom-k sketches of one hash, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored
from runloom.llm.words import mix, windows, words

#: Retained values of a sketch, and how many standard deviations a sketch of linked texts may fall short of what is expected.
SKETCH = 64
DEVIATIONS = 5.0
#: Lists of at most so many texts give all their pairs; longer ones meet a centre first, then in blocks of ``BLOCK``.
SHORT_LIST = 8
BLOCK = 512
_TILE = 256


def _shingles(column: pa.Array, size: int):
    """(row, sorted distinct shingle hashes) of every text, in order."""
    for first, owner, word, *_, at in words(column, lower=True):
        place, value = windows(owner, word, size)
        texts = len(at) - 1
        cuts = np.searchsorted(owner[place], np.arange(texts + 1))
        ends = np.searchsorted(owner, np.arange(texts + 1))
        for i in range(texts):
            own = value[cuts[i] : cuts[i + 1]]
            if not len(own) and ends[i] < ends[i + 1]:
                # fewer words than a shingle: the whole sequence is one
                whole = np.uint64(ends[i + 1] - ends[i])
                with np.errstate(over="ignore"):
                    for w in word[ends[i] : ends[i + 1]]:
                        whole = mix(np.array([whole * np.uint64(0xA24BAED4963EE407) + w]))[0]
                own = np.array([whole])
            yield first + i, np.unique(own)


def _signatures(size: int, k: int):
    def run(batches):
        for batch in batches:
            n, same, sketch = [], [], []
            for _, values in _shingles(batch.column("text"), size):
                n.append(len(values))
                same.append(hashlib.md5(values.tobytes(), usedforsecurity=False).digest())
                sketch.append(values[:k].view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sketch])]), pa.int32()),
                pa.array(np.concatenate([*sketch, np.zeros(0, np.int64)])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("twin"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists],
                ["doc_id", "twin", "n_shingles", "same", "sketch"],
            )

    return run


def signatures(docs: DataFrame, size: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, twin, n_shingles, same, sketch): set size, digest of the set, its ``k`` smallest hashes."""
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text")
    return rows.mapInArrow(_signatures(size, k), "doc_id long, twin long, n_shingles long, same binary, sketch array<long>")


def _least_shared(n, percent: int, k: int):
    """Values that the sketch of a set of ``n`` shares with that of any set linked to it (all but less than 1e-5 of the pairs)."""
    m, p = F.least(n, F.lit(k)), percent / 100
    short = F.sqrt(m * F.lit(p * (1 - p))) * DEVIATIONS
    # a set and all that can be linked to it fit into their sketches: no estimate, no allowance
    short = F.when(n <= F.lit(int(p * k)), F.lit(0.0)).otherwise(short)
    return F.greatest(F.lit(1), F.ceil(m * F.lit(percent) / 100 - short - 1e-9)).cast("int")


def inverted_lists(classes: DataFrame, percent: int, k: int = SKETCH) -> DataFrame:
    """(value, node, members): the retained values under which a text must be met, with the length of the list.

    Sketches that share t values agree on one of the first k - t + 1 of each, in any common order. In order of rising frequency
    these are the rarest: values that only one text retains cost nothing, and common passages are never listed unless texts
    consist of them.
    """
    spread = classes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    counts = stored(spread.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select(F.col("value").alias("v"), "c"), "near-counts")
    shared = spread.join(counts, F.col("value") == F.col("v")).groupBy("node", "n_shingles").agg(F.collect_list(F.struct("c", "value")).alias("held"))
    kept = F.least("n_shingles", F.lit(k)).cast("int")
    # the values that no other text has come first in the order
    room = kept - _least_shared(F.col("n_shingles"), percent, k) + 1 - (kept - F.size("held"))
    # the text whose values most others share is nearest to all of them: the best centre of a group of near copies
    common = F.aggregate("held", F.lit(0).cast("long"), lambda total, h: total + h["c"])
    listed = shared.where(room > 0).select("node", common.alias("common"), F.explode(F.slice(F.sort_array("held"), F.lit(1), room)).alias("h"))
    members = stored(listed.select("h.value", "node", "common"), "near-members")
    centre = F.max(F.struct("common", "node"))["node"]
    sizes = members.groupBy("value").agg(F.count("*").alias("members"), centre.alias("centre")).where("members > 1")
    sizes = stored(sizes.withColumnRenamed("value", "v"), "near-lists")
    return stored(members.join(sizes, F.col("value") == F.col("v")).drop("v", "common"), "near-listed")


def _alike(a: np.ndarray, b: np.ndarray, percent: int, k: int) -> bool:
    """Whether the bottom-k sketch of the union, made from both sketches, allows for the similarity asked for.

    Sketches of fewer than ``k`` values are the sets themselves: their whole union is exact and needs no allowance.
    """
    whole = len(a) < k and len(b) < k
    union = np.union1d(a, b) if whole else np.union1d(a, b)[:k]
    shared = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    p, n = percent / 100, len(union)
    short = 0 if whole else DEVIATIONS * math.sqrt(n * p * (1 - p))
    return shared.sum() >= n * p - short - 1e-9


def _estimated(percent: int, k: int):
    def run(batches):
        for batch in batches:
            a, b = (_lists(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            passed = pa.array([_alike(x, y, percent, k) for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(passed)

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(column) else []


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the ``column`` of both nodes; the larger side of a hot node is split by Spark."""
    for end in ("a", "b"):
        own = table.select(F.col("node").alias(f"{end}_"), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(own, F.col(end) == F.col(f"{end}_")).drop(f"{end}_")
    return pairs


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int = SKETCH) -> DataFrame:
    return _both(pairs, classes, "sketch").mapInArrow(_estimated(percent, k), "a long, b long")


def _block_links(percent: int, k: int):
    """Of one block of texts against another of the same list: links that join components, verified on the full sets.

    A pair that meets in several lists is taken up in the first of them only; a pair that earlier links of the block have
    joined needs no check.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, comp, side, value = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "side", "value"))
        whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("whole").combine_chunks()]
        earlier = [(x := np.array(y.as_py(), np.int64))[x < value[0]] for y in table.column("listed")]
        parent: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for low in range(0, len(left), _TILE):
            for high in range(0, len(right), _TILE):
                a, b = left[low : low + _TILE], right[high : high + _TILE]
                open_ = comp[a][:, None] != comp[b][None, :]
                if not open_.any() or not (open_ := open_ & (_shared(earlier, a, b) == 0)).any():
                    continue
                size_a, size_b = (np.array([len(whole[i]) for i in at]) for at in (a, b))
                least, p = np.minimum(size_a[:, None], size_b[None, :]), percent / 100
                kept = np.minimum(least, k)
                # sketches share at least what the sketch of their union does
                open_ &= 100 * least >= percent * np.maximum(size_a[:, None], size_b[None, :])
                open_ &= _shared([x[:k] for x in whole], a, b) >= kept * p - DEVIATIONS * np.sqrt(kept * p * (1 - p)) - 1e-6
                for x, y in zip(*np.nonzero(open_)):
                    i, j = a[x], b[y]
                    c, d = root(int(comp[i])), root(int(comp[j]))
                    if c != d:
                        both = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
                        if 100 * both >= percent * (len(whole[i]) + len(whole[j]) - both):
                            parent[max(c, d)] = min(c, d)
                            links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of the ``left`` sets shares with each of the ``right`` ones."""
    rows = [sets[i] for i in [*left, *right]]
    value, column = np.unique(np.concatenate(rows), return_inverse=True)
    held = np.zeros((len(rows), max(1, len(value))), np.float32)
    held[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), column] = 1
    return held[: len(left)] @ held[len(left) :].T


def _open_links(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Links of long lists between texts that are not in one component yet, found in blocks of bounded size.

    Texts of the centre's component need not meet each other. The others, cut into blocks, meet one another and
    blocks of that component. A block pair holds at most 2 * ``BLOCK`` texts on average.
    """
    marked = _labelled(lists.where(F.col("members") > SHORT_LIST), labels)
    centres = marked.where("node = centre").select(F.col("value").alias("v"), F.col("comp").alias("major"))
    marked = stored(marked.join(stored(centres, "near-centres"), F.col("value") == F.col("v")).drop("v").withColumn("minor", F.col("comp") != F.col("major")), "near-marked")
    sizes = marked.groupBy("value").agg(F.sum(F.col("minor").cast("long")).alias("minors"), F.count("*").alias("all")).where("minors > 0")
    blocks = sizes.select(
        F.col("value").alias("v"),
        F.ceil(F.col("minors") / BLOCK).cast("int").alias("mb"),
        F.ceil((F.col("all") - F.col("minors")) / BLOCK).cast("int").alias("jb"),
    )
    rows = marked.join(stored(blocks, "near-blocks"), F.col("value") == F.col("v"))
    mb, jb, spot = F.col("mb"), F.col("jb"), F.xxhash64("node")
    own = F.pmod(spot, F.when(F.col("minor"), mb).otherwise(jb)).cast("int")
    rows = rows.select("value", "node", "comp", "minor", mb, jb, own.alias("own"))
    none, every = F.lit(0), F.lit(1)
    # a minor block is the left side against itself, later minor blocks and all blocks of the major component
    as_left = rows.where("minor").select(
        "value", "node", "comp", F.col("own").alias("x"),
        F.explode(F.sequence(F.col("own"), mb + jb - 1)).alias("y"), none.alias("side"),
    )
    minor_right = rows.where("minor").select("value", "node", "comp", F.explode(F.sequence(none, F.col("own"))).alias("x"), F.col("own").alias("y"), every.alias("side"))
    major_right = rows.where("not minor").select("value", "node", "comp", F.explode(F.sequence(none, mb - 1)).alias("x"), (mb + F.col("own")).alias("y"), every.alias("side"))
    met = as_left.unionByName(minor_right).unionByName(major_right)
    listed = rows.groupBy("node").agg(F.collect_list("value").alias("listed"))
    whole = stored(sets.join(listed, "node").withColumnRenamed("node", "n"), "near-open")
    met = met.join(whole, F.col("node") == F.col("n")).drop("n")
    return met.groupBy("value", "x", "y").applyInArrow(_block_links(percent, k), "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("n_"), "root")
    joined = rows.join(own, F.col("node") == F.col("n_"), "left")
    return joined.withColumn("comp", F.coalesce("root", "node")).drop("n_", "root")


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            sets = [values.tobytes() for _, values in _shingles(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "whole"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("whole_a"), batch.column("whole_b")):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): each node moves to its smallest neighbour until no link is left.

    Every step is a grouped minimum and joins of small tables, written so that nothing is computed twice.
    """
    left = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not left.isEmpty():
        ways = left.select("a", "b").union(left.select("b", "a"))
        moves = ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        moves = stored(moves.where("from <> to"), "moves")
        to_a, to_b = (moves.select(F.col("from").alias(f"f{c}"), F.col("to").alias(f"t{c}")) for c in "ab")
        moved = left.join(to_a, F.col("a") == F.col("fa"), "left").join(to_b, F.col("b") == F.col("fb"), "left")
        moved = moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        left = stored(moved.where("a <> b").distinct(), "links")
        labels = stored(
            labels.join(moves, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels"
        )
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, twin, n_shingles, component_id, kept): documents linked when 100 * intersection >= ``percent`` * union.

    Words are those of the whole text with A-Z in lower case; a document's set are its distinct ``size``-word shingles.

    1. Equal sets become one class. 2. Inverted lists of the rarest retained values give pairs: all pairs of short lists, and the
    centre of a long list with its members. 3. The union-sketch estimate drops pairs, the full sets verify the rest.
    4. Long lists whose members are not yet in one component give the links between components, block by block. Since components
    are asked for, pairs inside one need no check; every pair between components that shares a list is checked, whatever the
    list's length, so that no link between components is lost.

    component_id is the smallest doc_id that links lead to, ``twin`` the hash of the text.
    * null or empty text, or no word: an empty set, linked with nothing; * fewer words than a shingle: the whole sequence is one;
    * repeated rows are documents of one class; * rows that share a doc_id but not the text are linked only if alike;
    * null doc_id: linked like others, never a component_id unless all are null; * extra columns are ignored.
    """
    own = stored(signatures(docs, size, k), "near-signatures")
    filled = own.where("n_shingles > 0")
    grouped = filled.groupBy("same").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "twin")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    lists = inverted_lists(classes, percent, k)
    short = lists.where(F.col("members") <= SHORT_LIST).select("value", "node")
    pairs = short.join(short.select(F.col("value").alias("v"), F.col("node").alias("b")), (F.col("value") == F.col("v")) & (F.col("node") < F.col("b")))
    pairs = pairs.select(F.col("node").alias("a"), "b")
    stars = lists.where((F.col("members") > SHORT_LIST) & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    first = stored(estimated(pairs.union(stars).distinct(), classes, percent, k), "near-pairs")
    # texts that no list has are alone; the full sets of the others are made once
    met = stored(lists.select("node").distinct(), "near-met")
    rows = classes.select("node", "row.doc_id", "row.twin").join(met, "node").select("node", F.col("doc_id").alias("d"), F.col("twin").alias("t"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text").join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")))
    sets = texts.select("node", "text").mapInArrow(_full_sets(size), "node long, whole binary").dropDuplicates(["node"])
    sets = stored(sets, "near-sets")

    links = stored(_both(first, sets, "whole").mapInArrow(_verified(percent), "a long, b long"), "near-links")
    labels = components(links)
    more = stored(_open_links(lists, labels, sets, percent, k), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    roots = _labelled(classes.select("same", "node", "least"), labels)
    least = stored(roots.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "c"), "near-roots")
    by_class = stored(roots.join(least, F.col("comp") == F.col("c")).select(F.col("same").alias("s"), "component_id"), "near-result")
    joined = own.join(by_class, (F.col("same") == F.col("s")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "twin", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

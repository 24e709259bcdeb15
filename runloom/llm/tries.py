"""Prefix trie of conversations by truncation peeling: from the greatest depth up, turns are stripped and equal prefixes regrouped."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import partitions, ship_package, stored

#: Turns of a block, the unit that is peeled at once, and conversations that it has at least, however long they are.
BLOCK_TURNS, BLOCK_ROWS = 1 << 18, 64
#: Bytes that identify a turn: so much of the SHA-256 of its role and text.
KEY = 16
_NODE, _EDGE, _ENDS = 0, 1, 2
_LONGS = "array<long>"
_FIELDS = {
    "kind": "int", "conv_id": "long", "depth": "long", "parent_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long",
    "saved": "long", "ends": "string", "key": "binary", "parent_key": "binary", "path": "binary", "lens": _LONGS, "n": _LONGS, "least": _LONGS,
    "children": _LONGS, "leaves": _LONGS, "saves": _LONGS,
}
_OUT = ", ".join(f"{n} {t}" for n, t in _FIELDS.items())
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), _LONGS: pa.list_(pa.int64())}
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
#: What a node gathers, and how.
_GATHERED = (("n", np.add), ("least", np.minimum), ("children", np.add), ("leaves", np.add), ("saves", np.add))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as structs of ``key``, which role and text decide, and ``n``, code points.

    Turns go by ``turn``, null first; ties by role, then by key. Null role or text is empty. Rows without conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), F.substring(digest, 1, 2 * KEY).alias("key"), F.char_length(text).cast("long").alias("n"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("turns"))


class _Block:
    """Rows in the order of their paths; what each adds to its nodes, from the root on."""

    def __init__(self, rows: list[dict], ids: bool):
        self.paths = [r["path"] for r in rows]
        self.depth = np.array([len(p) // KEY for p in self.paths], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.depth + 1)])
        self.ids = np.array([r["conv_id"] for r in rows], np.int64)
        self.lens = np.concatenate([np.array([0, *r["lens"]], np.int64) for r in rows])
        self.shared = self._shared()
        if ids:  # conversations: each counts once, where it ends
            last = self.at[1:] - 1
            self.adds = {f: np.zeros(len(self.lens), np.int64) for f, _ in _GATHERED}
            self.adds["least"][:] = _NONE
            self.adds["n"][last], self.adds["least"][last] = 1, self.ids
            self.first = self.depth
        else:  # outer paths of other blocks: each has something for any of its nodes
            self.adds = {f: np.concatenate([np.array(r[f], np.int64) for r in rows]) for f, _ in _GATHERED}
            self.first = np.zeros(len(rows), np.int64)

    def _shared(self) -> np.ndarray:
        """How many turns each row has in common with the one before it; -1 for the first."""
        joined = b"".join(self.paths)
        keys = np.frombuffer(joined, np.uint64).reshape(-1, KEY // 8) if joined else np.zeros((0, KEY // 8), np.uint64)
        start = np.concatenate([[0], np.cumsum(self.depth)])
        out = np.zeros(len(self.depth), np.int64)
        out[0] = -1
        pair = np.arange(1, len(self.depth))
        both = np.minimum(self.depth[:-1], self.depth[1:])
        level = 0
        while len(pair):
            pair = pair[both[pair - 1] > level]
            pair = pair[(keys[start[pair] + level] == keys[start[pair - 1] + level]).all(axis=1)]
            out[pair] += 1
            level += 1
        return out

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.paths[row][: KEY * depth]).digest()


def _ends(block: _Block, outer: bool) -> tuple[dict[int, str], list[dict]]:
    """SHA-256 of the ids that end at a node, by its first row; and, for nodes that other blocks may share, the ids themselves."""
    m = len(block.depth)
    new = np.ones(m, bool)
    new[1:] = ~((block.shared[1:] == block.depth[1:]) & (block.depth[1:] == block.depth[:-1]))
    starts = np.flatnonzero(new)
    # the turns in common with the first and with the last row
    left = np.minimum.accumulate(np.concatenate([[_NONE], block.shared[1:]]))
    right = np.concatenate([np.minimum.accumulate(block.shared[1:][::-1])[::-1], [_NONE]])
    done, open_ = {}, []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), m]):
        text = ",".join(map(str, block.ids[a:b].tolist()))
        d = int(block.depth[a])
        if outer and (left[a] >= d or right[a] >= d):
            open_.append({"kind": _ENDS, "conv_id": int(block.ids[a]), "key": block.key(a, d), "ends": text})
        else:
            done[a] = hashlib.sha256(text.encode()).hexdigest()
    return done, open_


def _peel(block: _Block, ids: bool, outer: bool) -> list[dict]:
    """Nodes of a block from the greatest depth up; with ``outer``, those on the first and last path stay open and become edges.

    At each depth the nodes that survive from below meet the conversations that end here; items with the same prefix are
    neighbours and become one node, which then loses its last turn.
    """
    m, top = len(block.depth), int(block.depth.max())
    ends, out = _ends(block, outer) if ids else ({}, [])
    names = [f for f, _ in _GATHERED]
    items = {f: np.zeros(0, np.int64) for f in ("row", *names)}
    edges = {side: {f: [] for f in names} for side in (0, m - 1)} if outer else {}
    below: list[dict] = []  # the nodes one turn deeper whose parents are looked for, with their rows
    order = np.argsort(block.depth, kind="stable")
    ranked = block.depth[order]
    for d in range(top, -1, -1):
        low, high = np.searchsorted(ranked, [d, d + 1])
        rows = np.sort(order[low:high]) if ids else np.flatnonzero(block.depth >= d)
        place = block.at[rows] + d
        items = {f: np.concatenate([items[f], rows if f == "row" else block.adds[f][place]]) for f in items}
        turn = np.argsort(items["row"], kind="stable")
        items = {f: v[turn] for f, v in items.items()}
        row = items["row"]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) & (block.shared[row[1:]] < d)
        at = np.flatnonzero(head)
        node = {f: how.reduceat(items[f], at) for f, how in _GATHERED}
        node["row"] = row[at]
        left = outer and node["row"][0] == 0
        right = outer and block.depth[m - 1] >= d
        closed = np.ones(len(at), bool)
        if left:
            closed[0] = False
        if right:
            closed[-1] = False
        for child in below:
            g = int(np.searchsorted(node["row"], child.pop("row"), "right")) - 1
            if closed[g]:
                child["parent_id"] = int(node["least"][g])
            else:
                child["parent_key"] = block.key(int(node["row"][g]), d)
        sides = ((0, left, 0), (m - 1, right and not (left and len(at) == 1), len(at) - 1))
        for side, here, g in sides[: len(edges)]:
            if d <= block.depth[side]:
                for f in names:
                    edges[side][f].append(int(node[f][g]) if here else _NONE if f == "least" else 0)
        leaf = node["children"] == 0
        node["leaves"] = np.where(leaf, 1, node["leaves"])
        node["saves"] = node["saves"] + (node["n"] - 1) * block.lens[block.at[node["row"]] + d]
        below = []
        for g in np.flatnonzero(closed).tolist():
            r = int(node["row"][g])
            values = {f: int(node[f][g]) for f in names}
            below.append({
                "kind": _NODE, "row": r, "conv_id": values["least"], "depth": d, "n_convs": values["n"], "n_children": values["children"],
                "n_leaves": values["leaves"], "saved": values["saves"], "ends": (ends.get(r, _EMPTY) if block.depth[r] == d else _EMPTY) if ids else None,
                "key": None if ids else block.key(r, d),
            })
        out.extend(below)
        # a closed node hands its sums up; an open one only keeps its place
        items = {f: np.where(closed, 1 if f == "children" else node[f], _NONE if f == "least" else 0) for f in names} | {"row": node["row"]}
    for node in below:
        node.pop("row", None)
    if outer:
        for side, sums in edges.items():
            if side and all(x == 0 for x in sums["n"]) and not any(sums["children"]):
                continue  # the last path lies on the first
            lens = block.lens[block.at[side] + 1 : block.at[side + 1]].tolist()
            out.append({"kind": _EDGE, "conv_id": int(block.ids[side]), "path": block.paths[side], "lens": lens} | {f: v[::-1] for f, v in sums.items()})
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[t]) for n, t in _FIELDS.items()], list(_FIELDS))


def _peeled(ids: bool, outer: bool, block_turns: int, block_rows: int):
    def run(batches):
        held, turns = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                turns += len(row["lens"]) + 1
                if outer and turns >= block_turns and len(held) >= block_rows:
                    yield _batch(_peel(_Block(held, ids), ids, outer))
                    held, turns = [], 0
        if held:
            yield _batch(_peel(_Block(held, ids), ids, outer))

    return run


def _hashed(batches):
    """One SHA-256 a key over its chunks, which come in the order of their ids: the state of one key at a time."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        yield _pairs(out)
    if state:
        yield _pairs([(key, state.hexdigest())])


def _pairs(rows):
    keys, ends = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["ends_key", "ends_found"])


def prefix_trie(paths: DataFrame, block_turns: int = BLOCK_TURNS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per distinct prefix of turns.

    ``paths`` has ``conv_id``, one row each, and ``turns`` as ``conversation_turns`` makes them. A node is known by its smallest
    member, depth by depth; ``saved_tokens`` sums over its subtree what its members share, (members - 1) x code points of a
    node's last text; ``ends_sha256`` is that of the ids that end there, in order, joined by commas.

    Truncation peeling in blocks: conversations are range-partitioned by their paths (then by id, so that a conversation that
    a third of all rows repeat spreads), and a subtree is a stretch of that order. A block of bounded size is peeled from its
    greatest depth up: nodes that survive from below and conversations that end at this depth are merged by equal prefix, written
    out with their sums, lose their last turn and are regrouped. Only the nodes on a block's first and last path can have
    members elsewhere. They stay open, as at most two rows a block with what each has gathered, and these are peeled in the
    same way, hundreds of times fewer each round, until one block holds them all. A closed child of an open node finds
    its parent by an equi-join afterwards; the ids that end at an open node are chunks of text, hashed in order as a stream.

    * no turns: a conversation that ends at the root; * equal conversations: members and ends of the same nodes; * null conv_id:
    no part taken; * a single conversation must fit into a worker's memory, with 24 bytes a turn and no texts; * extra columns are
    ignored; * an empty table gives no row.
    """
    if block_rows < 8:
        raise ValueError("a block leaves two rows open, so blocks of fewer than eight rows would take many rounds")
    spark = paths.sparkSession
    ship_package(spark)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = paths.where("conv_id is not null").select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n"]).alias("lens"))

    def dealt(table: DataFrame, n: int) -> DataFrame:
        return table.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    first = stored(dealt(stored(rows, "trie-paths"), partitions(spark)).mapInArrow(_peeled(True, True, block_turns, block_rows), _OUT), "trie-blocks")
    edge = first.where(F.col("kind") == _EDGE).select("conv_id", "path", "lens", *(f for f, _ in _GATHERED))
    opened = []
    while True:
        size = edge.agg(F.count("*").alias("rows"), F.sum(F.size("lens") + 1).alias("turns")).first()
        last = size["rows"] <= block_rows or size["turns"] <= block_turns
        order = edge.repartition(1).sortWithinPartitions("path", "conv_id") if last else dealt(edge, max(1, min(size["rows"] // block_rows, size["turns"] // block_turns)))
        again = stored(order.mapInArrow(_peeled(False, not last, block_turns, block_rows), _OUT), "trie-edges")
        opened.append(again.where(F.col("kind") == _NODE))
        if last:
            break
        edge = again.where(F.col("kind") == _EDGE).select(edge.columns)
    outer = opened[0]
    for more in opened[1:]:
        outer = outer.unionByName(more)
    chunks = first.where(F.col("kind") == _ENDS).select("key", "conv_id", "ends")
    ended = chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(_hashed, "ends_key binary, ends_found string")
    outer = outer.join(ended, F.col("key") == F.col("ends_key"), "left").withColumn("ends", F.coalesce("ends_found", F.lit(_EMPTY)))
    columns = ["conv_id", "depth", "parent_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "key", "parent_key"]
    outer = stored(outer.select(columns), "trie-outer")
    nodes = first.where(F.col("kind") == _NODE).select(columns).unionByName(outer)
    parents = outer.select(F.col("key").alias("of"), F.col("conv_id").alias("found"))
    known = nodes.where("parent_key is null")
    looked = nodes.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("of"), "left").withColumn("parent_id", F.col("found"))
    every = known.select(columns).unionByName(looked.select(columns))
    return every.select(
        "conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of conversations as they are: rows of conv_id, turn, role and text."""
    return prefix_trie(conversation_turns(conversations))

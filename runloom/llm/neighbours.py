"""Approximate nearest neighbours: balanced parts of a neighbour graph, a small classifier that routes, exact reranking."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored

#: Rows and queries of one cell of the search.
CELL_ROWS, CELL_QUERIES = 1024, 1024
#: Rows that one task sends on to the parts of a part.
SENT_ROWS = 16384


class Router:
    """One hidden layer; gives each vector the logarithm of the odds of every part."""

    def __init__(self, parts: int):
        self.parts, self.probes = parts, parts
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        self.mean, self.scale = 0.0, 1.0

    def _forward(self, x: np.ndarray):
        (w, b), (v, c) = self.layers
        hidden = np.maximum(x @ w + b, 0)
        return hidden, hidden @ v + c

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1] if self.layers else np.zeros((len(x), self.parts))

    def fit(self, x: np.ndarray, part: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> None:
        self.mean, self.scale = x.mean(axis=0), float(x.std()) or 1.0
        x = (x - self.mean) / self.scale
        shapes = [(x.shape[1], hidden), (hidden, self.parts)]
        self.layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in shapes]
        moments = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        squares = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                h, out = self._forward(x[at])
                p = np.exp(out - out.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                back = (p @ self.layers[1][0].T) * (h > 0)
                slopes = [(x[at].T @ back, back.sum(axis=0)), (h.T @ p, p.sum(axis=0))]
                for i, layer in enumerate(slopes):
                    for j, g in enumerate(layer):
                        moments[i][j] = 0.9 * moments[i][j] + 0.1 * g
                        squares[i][j] = 0.999 * squares[i][j] + 0.001 * g * g
                        change = moments[i][j] / (1 - 0.9**step) / (np.sqrt(squares[i][j] / (1 - 0.999**step)) + 1e-8)
                        self.layers[i][j][...] -= 0.003 * change


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest rows of each row of a bounded sample."""
    norms, out = (x * x).sum(axis=1), []
    for low in range(0, len(x), 1024):
        d = norms[low : low + 1024, None] + norms[None] - 2 * x[low : low + 1024] @ x.T
        d[np.arange(d.shape[0]), np.arange(low, low + d.shape[0])] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 20) -> np.ndarray:
    """A part for each node: halves along the widest direction first, then moves that cut fewer edges while parts stay even."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        nodes, first, n = todo.pop()
        if n == 1:
            part[nodes] = first
            continue
        centred = x[nodes] - x[nodes].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = nodes[np.argsort(centred @ axis, kind="stable")]
        cut = len(nodes) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most, size = int(np.ceil(slack * len(x) / parts)), np.bincount(part, minlength=parts)
    source = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    target = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        near = np.zeros((len(x), parts), np.int32)
        np.add.at(near, (source, part[target]), 1)
        best = near.argmax(axis=1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if size[best[node]] < most:
                size[part[node]] -= 1
                size[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if not moved:
            break
    return part


def learn_router(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 5) -> Router:
    """Fit on the distinct rows of a bounded sample; a fifth of it, unseen, sets how many parts a query needs for ``recall``."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 64))
    router = Router(parts)
    if parts == 1:
        return router
    x = x[rng.permutation(len(x))]
    tried = len(x) // 5
    fitted = x[tried:]
    router.fit(fitted, balanced_parts(fitted, neighbour_graph(fitted, k), parts), rng)
    odds = router.odds(x)
    own = odds.argmax(axis=1)
    near = neighbour_graph(x, k)[:tried]
    place = np.argsort(np.argsort(-odds[:tried], axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1).ravel()
    share = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    router.probes = int(np.searchsorted(share, recall) + 1)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _choices(router: Router, odds: np.ndarray, sizes: np.ndarray | None, k: int) -> list[np.ndarray]:
    """The most probable part of each row; with ``sizes`` (rows of the parts), as many as the router asks for and until they hold over ``k`` rows."""
    if sizes is None:
        return list(odds.argmax(axis=1)[:, None])
    out = []
    for order in np.argsort(-odds, axis=1, kind="stable"):
        enough = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
        out.append(order[: max(router.probes, enough)])
    return out


def _placed(rows, chosen: list[np.ndarray], up: int, base: int) -> pa.Table:
    """A row per vector and chosen part; part ``i`` of part ``up`` has the number ``up * base + 1 + i``."""
    at = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
    part = up * base + 1 + np.concatenate([np.zeros(0, np.int64), *chosen]).astype(np.int64)
    kept = pa.Table.from_arrays([rows.column("vec_id"), rows.column("vec")], ["vec_id", "vec"]).take(pa.array(at))
    return kept.append_column("part", pa.array(part, pa.int64()))


def _routed(shared, sizes: np.ndarray | None, k: int, base: int):
    def run(batches):
        router = shared.value
        for batch in batches:
            yield from _placed(batch, _choices(router, router.odds(_matrix(batch.column("vec"))), sizes, k), 0, base).to_batches()

    return run


def _learned(parts: int, k: int, recall: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        router = learn_router(_matrix(rows.column("vec").combine_chunks()), parts, k, recall)
        kept = [router] if router.parts > 1 else []
        return pa.table({"part": pa.array([key[0].as_py() for _ in kept], pa.int64()), "router": pa.array([pickle.dumps(r) for r in kept], pa.binary())})

    return run


def _sent_on(k: int, base: int):
    def run(key, rows: pa.Table, routers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["vec_id", "vec", "part"])
        router, held = pickle.loads(routers.column("router")[0].as_py()), routers.column("held")[0].as_py()
        sizes = None
        if held is not None:
            sizes = np.zeros(router.parts, np.int64)
            for part in held:
                sizes[part["sub"]] = part["count"]
        odds = router.odds(_matrix(rows.column("vec").combine_chunks()))
        return _placed(rows, _choices(router, odds, sizes, k), key[0].as_py(), base)

    return run


def _send_on(rows: DataFrame, routers: DataFrame, k: int, base: int) -> DataFrame:
    """Rows of the parts that have a router go to its parts, a bounded number of rows a task; the others stay where they are."""
    blocks = rows.groupBy("part").count().join(routers.select("part"), "part").select("part", F.ceil(F.col("count") / SENT_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "part").select("vec_id", "vec", "part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
    copies = routers.join(blocks, "part").select("part", "router", "held", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = dealt.groupBy("part", "block").cogroup(copies.groupBy("part", "block"))
    sent = met.applyInArrow(_sent_on(k, base), f"vec_id long, vec {dict(rows.dtypes)['vec']}, part long")
    return rows.join(routers.select("part"), "part", "left_anti").select("vec_id", "vec", "part").unionByName(sent)


def _split(index: DataFrame, routed: DataFrame, k: int, parts: int, sample: int, recall: float, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Parts of over ``leaf`` rows are cut into parts of their own, each by a router learned on a bounded draw of it, until none is left to cut.

    A level allows half the misses of the level above, so that all of them miss at most twice what the first may.
    """
    base, level = parts + 1, 0
    while True:
        big = index.groupBy("part").count().where(F.col("count") > leaf)
        if big.isEmpty():
            return index, routed
        level += 1
        draw = F.pmod(F.xxhash64(F.lit(3 + level), "vec_id"), F.lit(1 << 30)) < F.lit(float(sample)) / F.col("count") * float(1 << 30)
        # copies of a vector teach nothing more
        drawn = index.join(big, "part").where(draw).select("part", "vec").dropDuplicates()
        learned = drawn.groupBy("part").applyInArrow(_learned(parts, k, 1 - (1 - recall) / 2**level), "part long, router binary")
        routers = stored(learned, "neighbour-routers")
        if routers.isEmpty():
            # what cannot be cut are copies of few vectors
            crowded = index.join(big.select("part"), "part", "left_semi").select(*index.columns)
            return stored(index.join(big.select("part"), "part", "left_anti").select(*index.columns).unionByName(_least_copies(crowded, k)), "neighbour-index"), routed
        nothing = F.lit(None).cast("array<struct<sub: int, count: bigint>>")
        index = stored(_send_on(index, routers.withColumn("held", nothing), k, base), "neighbour-index")
        child = index.groupBy("part").count().select(
            F.expr(f"(part - 1) div {base}").alias("up"), F.struct(((F.col("part") - 1) % base).cast("int").alias("sub"), "count").alias("one")
        )
        held = child.groupBy("up").agg(F.collect_list("one").alias("held")).withColumnRenamed("up", "part")
        routed = stored(_send_on(routed, routers.join(held, "part"), k, base), "neighbour-queries")


def _least_copies(index: DataFrame, k: int) -> DataFrame:
    """Of equal vectors those that can be among the ``k`` nearest of anything: the ``k + 1`` smallest ids, of each ``k`` rows."""
    again = F.row_number().over(Window.partitionBy("part", "vec", "vec_id").orderBy("vec_id"))
    few = index.withColumn("_again", again).where(F.col("_again") <= k).drop("_again")
    smallest = F.dense_rank().over(Window.partitionBy("part", "vec").orderBy("vec_id"))
    return few.withColumn("_rank", smallest).where(F.col("_rank") <= k + 1).drop("_rank")


def _cells(index: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and rows of each part in cells, where every block of the one meets every block of the other."""
    x = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("x"))
    y = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("y"))
    blocks = x.join(y, "part")

    def cell(table: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return table.join(blocks, "part").select("vec_id", "vec", "part", mine.alias(f"{own}_"), every.alias(f"{other}_"))

    return cell(routed, "y", "x"), cell(index, "x", "y")


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, x = (_matrix(t.column("vec").combine_chunks()) for t in (queries, rows))
            ids = rows.column("vec_id").to_numpy()
            near = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T
            # the expansion only preselects, with room for its rounding; the score is that of the differences
            room = 1e-9 * (1 + np.abs(near).max() + (x * x).sum(axis=1).max())
            for i, query in enumerate(queries.column("vec_id").to_pylist()):
                other = np.flatnonzero(ids != query)
                if not len(other):
                    continue
                d = near[i, other]
                cut = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1] + room
                at = other[d <= cut]
                score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                for j in np.lexsort((ids[at], score))[:k]:
                    found[0].append(query)
                    found[1].append(int(ids[at][j]))
                    found[2].append(float(score[j]))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds)], names)

    return run


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector of finite numbers that is not zero, of the length that most have."""
    raw = F.col("embedding")
    number = raw.cast("array<double>")
    finite = F.forall(number, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)) & F.exists(number, lambda v: v != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & raw.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def nearest(
    embeddings: DataFrame, queries: Column | None = None, k: int = 10, parts: int = 32, sample: int = 6000, recall: float = 0.97,
    leaf: int = 65536,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of ``queries``, its own id apart.

    A draw of about ``sample`` vectors (the documented bound) makes a neighbour graph, cut into even parts; a small classifier
    learns the parts. It puts every row into its most probable part and sends a query to as many parts as an unseen share of the
    draw needed for ``recall``. A part of over ``leaf`` rows is cut and routed again in the same way, so the parts grow in number
    and not in size, and what is shuffled stays in proportion to the rows. There, blocks of queries meet blocks of rows, so that a
    part of any size is spread out; distances are exact on the original vectors, in double precision.

    * null vec_id, null vector, null, infinite or not-a-number components, only zeros, another length than most: no part taken;
    * fewer than ``k`` other rows: all of them; * ties: the smaller vec_id; * repeated vec_ids: a query is answered once, and each
    row of an id is a candidate; * an empty table gives no row; * extra columns are ignored.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = usable_vectors(embeddings)
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    drawn = rows.where(draw).select("vec").toPandas()["vec"]
    router = learn_router(np.array(drawn.tolist(), np.float64), parts, k, recall) if len(drawn) else Router(1)
    shared = spark.sparkContext.broadcast(router)
    kind, base = f"vec_id long, vec {dict(rows.dtypes)['vec']}, part long", parts + 1
    index = stored(rows.mapInArrow(_routed(shared, None, k, base), kind), "neighbour-index")
    sizes = np.zeros(router.parts, np.int64)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"] - 1] = r["count"]
    asked = rows.where(queries if queries is not None else F.col("vec_id") % 100 == 0).dropDuplicates(["vec_id"])
    routed = stored(asked.mapInArrow(_routed(shared, sizes, k, base), kind), "neighbour-queries")
    index, routed = _split(index, routed, k, parts, sample, recall, leaf)
    keys = ["part", "x_", "y_"]
    questions, candidates = _cells(index, routed)
    met = questions.groupBy(*keys).cogroup(candidates.groupBy(*keys))
    found = met.applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

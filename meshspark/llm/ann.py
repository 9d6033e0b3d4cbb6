"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded, documented sample (``SAMPLE`` vectors at most); every vector of the
table is put into the leaf that it descends to, in blocks of bounded size.  A query walks the tree
best bin first through a priority queue (a node's bound is its centre's product with the query plus
the query's length times the node's radius share), and scores the vectors of the leaves it visits in
double precision.  How many leaves are visited is widened until the recall of calibration queries,
measured against all vectors, reaches the target; a query whose leaves hold fewer than k others goes
on down its queue until they do.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; ties go to the smaller id; fewer candidates than k give fewer
rows; an empty table gives none.  Rows with equal ids are one candidate each, and none is its own
query's; of query rows with equal ids one (the smallest vector) asks.  Ids are cast to long.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import blocks, written

#: Vectors that the tree is fitted on, at most; rows that a leaf should hold; leaves, at most.
SAMPLE, LEAF, LEAVES = 16_384, 160, 4096
BRANCH = 8
BLOCK = 4096
HELD = 400_000  # rows (query, id, score) that a task merges at a time
CALIBRATION = 128


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


class Tree:
    """Nodes in arrays: children of each, centre and radius; leaves are numbered."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 11):
        self.centre, self.radius, self.kids, self.leaf = [], [], [], []
        self.rng = np.random.default_rng(seed)
        self.n_leaves = 0
        self._grow(x, max(1, leaves))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, x, leaves) -> int:
        me = len(self.kids)
        c = x.mean(axis=0)
        self.centre.append(c)
        self.radius.append(float(np.sqrt(((x - c) ** 2).sum(axis=1)).mean()))
        self.kids.append(())
        self.leaf.append(-1)
        if leaves > 1 and len(x) > BRANCH:
            of = self._kmeans(x, min(BRANCH, leaves))
            groups = [x[of == k] for k in np.unique(of)]
            if len(groups) > 1:
                self.kids[me] = tuple(self._grow(g, max(1, round(leaves * len(g) / len(x)))) for g in groups)
                return me
        self.leaf[me] = self.n_leaves
        self.n_leaves += 1
        return me

    def _kmeans(self, x, k, steps=12):
        c = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(steps):
            of = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[of == j].mean(axis=0) if (of == j).any() else x[self.rng.integers(len(x))] for j in range(k)])
        return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to, by the nearest centre."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if not self.kids[node]:
                out[at] = self.leaf[node]
                continue
            kids = np.array(self.kids[node])
            c = self.centre[kids]
            of = ((c**2).sum(axis=1) - 2 * x[at] @ c.T).argmin(axis=1)
            todo += [(int(kids[j]), at[of == j]) for j in range(len(kids))]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones until they hold ``least`` of the ``held`` vectors."""
        bound = self.centre @ q + 0.5 * float(np.sqrt(q @ q)) * self.radius
        heap, out, have = [(-bound[0], 0)], [], least if held is None else 0
        while heap and (len(out) < most or have < least):
            _, node = heapq.heappop(heap)
            if self.kids[node]:
                for k in self.kids[node]:
                    heapq.heappush(heap, (-bound[k], k))
            else:
                out.append(self.leaf[node])
                if held is not None:
                    have += int(held[self.leaf[node]])
        return out


def matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return rows.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def best(q_ids, q, ids, x, k):
    """(query, id, score) arrays: for each query its ``k`` best of (ids, x); equal vectors get equal scores."""
    s = q @ x.T
    s[q_ids[:, None] == ids] = -np.inf
    at = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - at, axis=1)[:, s.shape[1] - at]
    with np.errstate(invalid="ignore"):
        near = (s > -np.inf) & (s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    near |= (s > -np.inf) & np.isinf(least)[:, None]
    i, j = np.nonzero(near)
    exact = np.concatenate([np.zeros(0), *[(x[j[c : c + 65_536]] * q[i[c : c + 65_536]]).sum(axis=1) for c in range(0, len(i), 65_536)]])
    return merged([(q_ids[i], ids[j], exact)], k)


def merged(found: list, k: int):
    """Each query's ``k`` best of (query, id, score) arrays, ties to smaller ids."""
    q, i, s = (np.concatenate([np.zeros(0, kind), *[f[c] for f in found]]) for c, kind in enumerate((np.int64, np.int64, np.float64)))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
    place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return q[place < k], i[place < k], s[place < k]


def _batch(found):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])


def top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_top(vectors: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true ``k`` best of a bounded set of queries, against all vectors in blocks."""

    def work(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            for i in range(0, len(ids), BLOCK):
                yield _batch(best(q_ids, q, ids[i : i + BLOCK], x[i : i + BLOCK], k))

    return top(vectors.mapInArrow(work, "query_id long, id long, score double"), k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, target: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding", stats: dict | None = None) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best; queries are the ids divisible by ``every``."""
    spark = vectors.sparkSession
    ok = usable(vectors, id_col, vec_col)
    dims = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    ok = written(ok.filter(F.size("v") == dims["d"]), "vectors")
    n = ok.count()
    drawn = ok.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).toArrow()  # at most SAMPLE vectors
    tree = Tree(matrix(drawn.column("v")), int(min(LEAVES, max(1, n // LEAF))))
    shared = spark.sparkContext.broadcast(tree)  # at most 2 LEAVES centres

    def put(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.assign(matrix(b.column(1))) if b.num_rows else [], pa.int64())], ["id", "v", "leaf"])

    placed = ok.mapInArrow(put, "id long, v array<double>, leaf long")
    # of query rows with equal ids the first in order asks; all of them are no candidates of it
    asked = ok.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))

    # calibration: a bounded set of queries, against all vectors
    some = asked.select("id", "v").orderBy(F.xxhash64("id", F.lit(2)), "id").limit(CALIBRATION).toArrow()
    visits = tree.n_leaves
    if len(some):
        q_ids, q = some.column("id").to_numpy(), matrix(some.column("v"))
        truth = exact_top(ok, q_ids, q, k).select("query_id", "id")
        own = truth.join(ok, "id").groupBy("query_id", "id").agg(F.min("v").alias("v")).select("query_id", "v").toArrow()  # at most CALIBRATION x k rows
        if len(own):
            leaf = tree.assign(matrix(own.column("v")))
            order = {int(i): {x: p for p, x in enumerate(tree.visits(v, tree.n_leaves))} for i, v in zip(q_ids, q)}
            place = np.sort([order[int(i)][int(x)] for i, x in zip(own.column("query_id").to_pylist(), leaf)])
            visits = int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1
    if stats is not None:
        stats |= {"leaves": tree.n_leaves, "visits": visits}

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column(1))
            leaves = [shared.value.visits(v, visits, held_by, k + own) for v, own in zip(x, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "leaves"])

    placed = written(placed, "placed")
    size = written(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "leaf-sizes")
    held_by = np.zeros(tree.n_leaves, np.int64)
    for row in size.collect():  # one row for each leaf
        held_by[row["leaf"]] = row["n"]
    tall = placed.join(F.broadcast(size.drop("n")), "leaf")  # one row for each leaf
    rows = tall.select(F.xxhash64("leaf", F.pmod(F.xxhash64("id"), "parts")).alias("block"), F.lit(0).alias("is_query"), "id", "v")
    wanted = asked.select("id", "v", "own").mapInArrow(ask, "id long, v array<double>, leaves array<long>").select("id", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(size.drop("n")), "leaf")
    rows = rows.unionByName(wanted.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "leaf", "id", "v").select(F.xxhash64("leaf", "part").alias("block"), F.lit(1).alias("is_query"), "id", "v"))

    def meet(batches):
        held, size = [], 0
        for t in blocks(batches, "block"):
            ids, x, asks = t.column("id").to_numpy(), matrix(t.column("v")), t.column("is_query").to_numpy() == 1
            if not asks.any() or asks.all():
                continue
            qi, qx, ci, cx = ids[asks], x[asks], ids[~asks], x[~asks]
            for i in range(0, len(qi), 512):
                held.append(best(qi[i : i + 512], qx[i : i + 512], ci, cx, k))
                size += len(held[-1][0])
            if size > HELD:  # what a query finds in the blocks of one task is merged, so a task returns k rows a query
                held = [merged(held, k)]
                size = len(held[0][0])
                if 2 * size > HELD:
                    yield _batch(held[0])
                    held, size = [], 0
        yield _batch(merged(held, k))

    met = rows.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "query_id long, id long, score double")
    return top(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

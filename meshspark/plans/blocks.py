"""Solving (I + 2 (L D)^n) z = phi over blocks of nodes, for operators too large to broadcast, symmetric or not.

Nodes are dealt into blocks of about ``BLOCK_NODES`` along a space-filling curve.  The operator's rows of a
block, packed, and the vectors of the right-hand sides on it lie in tables bucketed by block, so that an
iteration moves only the values that neighbouring blocks need: one row for each pair of blocks that touch.

The n-th power is never applied: 1 / (1 + 2 z^n) is the mean of 1 / (1 - z / c) over the n roots c of
1 + 2 z^n, so a filter of order n is the solution of about n / 2 complex systems whose condition is that of
order one.  These go through BiCGSTAB as two Spark jobs an iteration.  Each job adds up all its dot
products in one aggregate and carries what the next needs of preconditioned vectors, of which new ones
are linear combinations, so neighbours need no further exchange.  A system whose shadow residual has
become orthogonal starts again from its residual; converged ones stand still; only the number of open ones
comes to the driver.  The preconditioner solves each block exactly, by elimination over its breadth-first
levels; there is no coarse space, so iterations grow with the filter's scale over the blocks' width.

State is written at every step: executors may come and go.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import PreparedMesh
from ..sources.tables import cut, removed, shared_folder

BLOCK_NODES = 1024
#: Complex systems that advance together; a block's state holds about 200 bytes for each node and system.
SYSTEMS = 32
#: A verified residual may be so much larger than the recursive one.
SLACK = 30.0


class Bucketed:
    """A table bucketed by block in the shared folder; ``drop`` removes it."""

    def __init__(self, df: DataFrame, buckets: int, dealt: bool = False):
        self.spark, self.buckets, self.name = df.sparkSession, buckets, f"meshspark_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{self.name}"
        (df if dealt else df.repartition(buckets, "block")).write.format("parquet").option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        removed(self.df)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _spread(c):
    """The low 16 bits with a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve(node: DataFrame, grid: tuple | None) -> DataFrame:
    """(node_id, area, z): the place of each node on a Z-curve, by x and y, or by cell; by id where neither is known."""
    if {"x", "y"} <= set(node.columns):
        at = node.select("node_id", "area", "x", "y")
    elif grid:
        at = node.select("node_id", "area", F.floor(F.col("node_id") / grid[1]).alias("x"), (F.col("node_id") % grid[1]).alias("y"))
    else:
        return node.select("node_id", "area", F.col("node_id").alias("z"))
    e = at.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))]).first()
    wide = max(e["x1"] - e["x0"], e["y1"] - e["y0"]) or 1
    part = lambda c: F.floor((F.col(c) - e[f"{c}0"]) / wide * 65535).cast("long")
    return at.select("node_id", "area", F.shiftleft(_spread(part("x")), 1).bitwiseOR(_spread(part("y"))).alias("z"))


def _levels(indptr, col, m):
    """Breadth-first level of each node of a block, so that entries join neighbouring levels only."""
    level, at = np.full(m, -1, np.int32), 0
    rows = np.repeat(np.arange(m), np.diff(indptr))
    own = col < m
    a, b = np.concatenate([rows[own], col[own]]), np.concatenate([col[own], rows[own]])  # either direction joins
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(m + 1))
    todo = 0
    while todo < m:
        if level[todo] >= 0:
            todo += 1
            continue
        now = np.array([todo])
        while len(now):
            level[now] = at
            at += 1
            near = np.unique(np.concatenate([b[start[i] : start[i + 1]] for i in now]))
            now = near[level[near] < 0]
    return level


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its nodes, operator rows as CSR with outside nodes after its own, levels, and whom it needs."""
    block = int(pdf["block"].iloc[0])
    i, j, s, other = (pdf[c].to_numpy() for c in ("i", "j", "s", "other"))
    ids = np.unique(i)
    out = other != block
    halo, slot = np.unique(np.stack([other[out], j[out]], 1), axis=0, return_inverse=True)
    col = np.empty(len(i), np.int32)
    col[~out], col[out] = np.searchsorted(ids, j[~out]), len(ids) + slot.ravel()
    row = np.searchsorted(ids, i)
    order = np.lexsort((col, row))
    indptr = np.searchsorted(row[order], np.arange(len(ids) + 1)).astype(np.int32)
    needs = []
    for b in np.unique(halo[:, 0]):
        at = np.flatnonzero(halo[:, 0] == b)
        needs.append({"src": int(b), "nodes": halo[at, 1].astype(np.int64).tobytes(), "slots": at.astype(np.int32).tobytes()})
    level = _levels(indptr, col[order], len(ids))
    return pd.DataFrame([{"block": block, "ids": ids.astype(np.int64).tobytes(), "indptr": indptr.tobytes(), "col": col[order].tobytes(), "s": s[order].astype(np.float64).tobytes(), "level": level.tobytes(), "halo": len(halo), "needs": needs}])


PACKED = "block long, ids binary, indptr binary, col binary, s binary, level binary, halo int"
NEEDS = ", needs array<struct<src: long, nodes: binary, slots: binary>>"
SENDS = ", sends array<struct<dst: long, at: binary, slots: binary>>"


def _address(pack: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
    """A block's row with what it sends: to whom, which of its nodes, and their places there."""
    ids = np.frombuffer(pack["ids"].iloc[0], np.int64)
    sends = [{"dst": int(d), "at": np.searchsorted(ids, np.frombuffer(n, np.int64)).astype(np.int32).tobytes(), "slots": s} for d, n, s in zip(needs["dst"], needs["nodes"], needs["slots"])]
    return pack.drop(columns="needs").assign(sends=[sends])


def dealt(mesh: PreparedMesh, size: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(node_id, block); the operator's rows (block, i, j, s, other), a zero on every diagonal; how many blocks, and buckets for them."""
    spark = mesh.node.sparkSession
    n = mesh.node.count()
    parts = max(1, -(-n // size))
    buckets = int(min(parts, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    nodes = cut(curve(mesh.node, mesh.grid).repartitionByRange(parts, "z", "node_id").withColumn("block", F.spark_partition_id().cast("long")).select("node_id", "block"), "mesh-blocks")
    known = lambda c, b: nodes.select(F.col("node_id").alias(c), F.col("block").alias(b))
    rows = mesh.operator.select("i", "j", "s").unionByName(mesh.node.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.0).alias("s")))
    return nodes, rows.join(known("i", "block"), "i").join(known("j", "other"), "j"), parts, buckets


class BlockedMesh:
    """A mesh's operator in blocks; made once and used by every solve."""

    def __init__(self, mesh: PreparedMesh, size: int = BLOCK_NODES):
        self.nodes, rows, _, self.buckets = dealt(mesh, size)
        packs = cut(rows.groupBy("block").applyInPandas(_pack, PACKED + NEEDS), "mesh-packs")
        needs = packs.select(F.col("block").alias("dst"), F.explode("needs").alias("n")).select("dst", "n.*")
        self.op = Bucketed(packs.groupBy("block").cogroup(needs.groupBy("src")).applyInPandas(_address, PACKED + SENDS), self.buckets)
        removed(packs)


def roots(order: int) -> tuple[np.ndarray, np.ndarray]:
    """(c, weight): roots of 1 + 2 z^n of the upper half plane, and their weights in the mean's real part."""
    j = np.arange((order + 1) // 2)
    c = 0.5 ** (1 / order) * np.exp(1j * np.pi * (2 * j + 1) / order)
    weight = np.where(2 * j + 1 == order, 1.0, 2.0) / order
    return (c.real, weight) if order == 1 else (c, weight)


class Block:
    """A block's arithmetic for systems x - L(d x) / c."""

    def __init__(self, row: dict):
        of = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.indptr, self.col, self.s, self.level = of("ids", np.int64), of("indptr", np.int32), of("col", np.int32), of("s", np.float64), of("level", np.int32)
        self.m, self.halo, self.sends = len(self.ids), row["halo"], row["sends"]

    def lap(self, own, outside):
        g = np.concatenate([own, outside], 1)
        return np.add.reduceat(g[:, self.col] * self.s, self.indptr[:-1], axis=1)

    def eliminated(self, d, c):
        """``solve(r)`` for the block's own part of the systems, eliminated level after level."""
        rows = np.repeat(np.arange(self.m), np.diff(self.indptr))
        own = self.col < self.m
        i, j, s = rows[own], self.col[own], self.s[own]
        at = [np.flatnonzero(self.level == k) for k in range(int(self.level.max()) + 1)]
        place = np.empty(self.m, np.int64)
        for a in at:
            place[a] = np.arange(len(a))

        def part(k, other):
            e = np.flatnonzero((self.level[i] == k) & (self.level[j] == other))
            out = np.zeros((len(d), len(at[k]), len(at[other])), d.dtype if c.dtype == float else complex)
            np.add.at(out, (slice(None), place[i[e]], place[j[e]]), -s[e] * d[:, j[e]] / c[:, None])
            return out

        inverse, low, up = [], [None], []
        for k in range(len(at)):
            a = part(k, k)
            a[:, np.arange(len(at[k])), np.arange(len(at[k]))] += 1
            if k:
                low.append(part(k, k - 1))
                a -= low[k] @ (inverse[k - 1] @ up[k - 1])
            inverse.append(np.linalg.inv(a))
            if k + 1 < len(at):
                up.append(part(k, k + 1))

        def solve(r):
            x, y = np.empty(r.shape, np.result_type(r, inverse[0])), []
            for k, a in enumerate(at):
                b = r[:, a, None]
                y.append(inverse[k] @ (b - low[k] @ y[k - 1] if k else b))
            for k in reversed(range(len(at))):
                if k + 1 < len(at):
                    y[k] = y[k] - inverse[k] @ (up[k] @ y[k + 1])
                x[:, at[k]] = y[k][:, :, 0]
            return x

        return solve

    def outgoing(self, *vectors):
        """What each neighbour needs of the vectors: (places there, values)."""
        out = []
        for send in self.sends:
            at = np.frombuffer(send["at"], np.int32)
            out.append({"dst": send["dst"], "slots": send["slots"], "data": np.stack([v[:, at] for v in vectors]).tobytes()})
        return out

    def incoming(self, got, count, systems, kind):
        out = np.zeros((count, systems, self.halo), kind)
        for g in got or []:
            slots = np.frombuffer(g["slots"], np.int32)
            out[:, :, slots] = np.frombuffer(g["data"], kind).reshape(count, systems, len(slots))
        return out


STATE = "block long, vectors binary, scalars binary, dots array<double>, open int, out array<struct<dst: long, slots: binary, data: binary>>"
TYPES = pa.schema([("block", pa.int64()), ("vectors", pa.binary()), ("scalars", pa.binary()), ("dots", pa.list_(pa.float64())), ("open", pa.int32()), ("out", pa.list_(pa.struct([("dst", pa.int64()), ("slots", pa.binary()), ("data", pa.binary())])))])


def _flat(*dots) -> list[float]:
    """Complex sums of each system as real numbers that Spark can add up."""
    return np.stack([np.asarray(x, complex) for x in dots]).ravel().view(np.float64).tolist()


def _dot(a, b):
    return np.einsum("fm,fm->f", np.conj(a), b)


def _guarded(a, b, on):
    """a / b where ``on`` and b is not zero, else zero."""
    ok = on & (b != 0) & np.isfinite(a) & np.isfinite(b)
    return np.where(ok, a / np.where(ok, b, 1), 0)


class Steps:
    """The steps of one batch of systems, as functions of a block, its state, what neighbours sent and the sums of dots."""

    def __init__(self, order: int, n_fields: int, tol: float):
        c, self.weight = roots(order)
        self.kind, self.n_roots, self.tol = c.dtype, len(c), tol
        self.c = np.tile(c, n_fields)
        self.systems = len(self.c)

    def vectors(self, blob, count):
        return list(np.frombuffer(blob, self.kind).reshape(count, self.systems, -1))

    def sums(self, flat, count):
        out = np.asarray(flat, np.float64).view(complex).reshape(count, self.systems)
        return out if self.kind == complex else out.real

    def row(self, block, vectors, scalars, dots, n_open, out):
        return {"block": block, "vectors": np.stack([v.astype(self.kind) for v in vectors]).tobytes(), "scalars": np.stack([np.asarray(s, complex) for s in scalars]).tobytes(), "dots": dots, "open": n_open, "out": out}

    def scalars(self, blob):
        return np.frombuffer(blob, complex).reshape(-1, self.systems)

    def start(self, placed: DataFrame, ids: list, buckets: int) -> Bucketed:
        """Each block's (phi, zero, d) of the fields ``ids``."""

        def pack(pdf):
            block, n = int(pdf["block"].iloc[0]), len(pdf) // len(ids)
            pdf = pdf.sort_values(["_f", "node_id"])
            value, k = (pdf[c].to_numpy(np.float64).reshape(len(ids), n) for c in ("value", "k"))
            phi, d = np.repeat(value, self.n_roots, 0), np.repeat(1 / k**2, self.n_roots, 0)
            return pd.DataFrame([self.row(block, [phi, np.zeros_like(phi), d], [np.zeros(self.systems)], [0.0], self.systems, [])])

        return Bucketed(placed.groupBy("block").applyInPandas(pack, STATE), buckets)

    def filtered(self, ids: list, nodes, phi, x) -> pa.RecordBatch:
        """(_f, node_id, filtered) of a block: the mean over the roots."""
        low = phi[:: self.n_roots].real + np.einsum("r,frm->fm", self.weight, x.real.reshape(len(ids), self.n_roots, -1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(nodes))), pa.array(np.tile(nodes, len(ids))), pa.array(low.ravel())], ["_f", "node_id", "filtered"])

    def answer(self, op: DataFrame, state: DataFrame, placed: DataFrame, unpack) -> DataFrame:
        solved = op.select("block", "ids").join(state.select("block", "vectors"), "block").mapInArrow(unpack, "_f long, node_id long, filtered double")
        return cut(placed.join(solved, ["_f", "node_id"]).select("_f", "node_id", "value", "k", "filtered"), "filtered")

    def send(self, b: Block, block, state, got, sums):
        """From (phi, x, d, ...): what neighbours need for the residual."""
        phi, x, d = self.vectors(state["vectors"], 3)
        return self.row(block, [phi, x, d], [self.scalars(state["scalars"])[0]], _flat(np.zeros(self.systems)), self.systems, b.outgoing(d * (phi + x)))

    def begin(self, b: Block, block, state, got, sums):
        """The residual L(d (phi + x)) / c - x, preconditioned, as if a step of type B had ended."""
        phi, x, d = self.vectors(state["vectors"], 3)
        r = b.lap(d * (phi + x), b.incoming(got, 1, self.systems, self.kind)[0]) / self.c[:, None] - x
        z, no = b.eliminated(d.real, self.c)(r), np.zeros_like(r)
        rr, none = _dot(r, r), np.zeros(self.systems)
        goal = self.scalars(state["scalars"])[0]
        return self.row(block, [phi, x, r, no, no, z, no, no, r, d], [none, none, goal, np.ones(self.systems), none], _flat(none, none, rr, none, rr), self.systems, b.outgoing(d * z, no, no, no))

    def direction(self, b: Block, block, state, got, sums):
        """Step A: x and r take the last step, y is the new preconditioned direction, v its image."""
        phi, x, s, t, y, z, q, w, r0, d = self.vectors(state["vectors"], 10)
        alpha, rho, goal, on, r00 = self.scalars(state["scalars"])
        if self.kind != complex:
            alpha, rho = alpha.real, rho.real
        ts, tt, r0s, r0t, ss = self.sums(sums, 5)
        goal, on = goal.real, on.real > 0
        goal = np.where(goal > 0, goal, ss.real * self.tol**2)
        omega = _guarded(ts, tt, on)
        rr = ss.real - np.where(tt != 0, np.abs(ts) ** 2 / np.where(tt != 0, tt.real, 1), 0)
        now = r0s - omega * r0t
        r00 = np.where(r00.real > 0, r00.real, ss.real)
        beta = _guarded(now * alpha, rho * omega, on)
        again = on & ((np.abs(now) ** 2 <= 1e-16 * np.abs(rr) * r00) | ~np.isfinite(beta))
        beta = np.where(again, 0, beta)
        r00 = np.where(again, np.abs(rr), r00)
        a, o, e = alpha[:, None], omega[:, None], beta[:, None]
        x, r = x + a * y + o * z, s - o * t
        r0 = np.where(again[:, None], r, r0)
        u = z - o * q
        y = u + e * (y - o * w)
        hz, hq, hy, hw = b.incoming(got, 4, self.systems, self.kind)
        v = y - b.lap(d * y, hz - o * hq + e * (hy - o * hw)) / self.c[:, None]
        w = b.eliminated(d.real, self.c)(v)
        return self.row(block, [phi, x, r, y, v, u, w, r0, d], [goal, on, r00], _flat(_dot(r0, v), _dot(r0, r), _dot(r, r)), int(on.sum()), b.outgoing(d * u, d * w, d * y))

    def descent(self, b: Block, block, state, got, sums):
        """Step B: the residual less alpha v, its preconditioned form z, and its image t."""
        phi, x, r, y, v, u, w, r0, d = self.vectors(state["vectors"], 9)
        goal, on, r00 = self.scalars(state["scalars"]).real
        r0v, rho, rr = self.sums(sums, 3)
        on = (on > 0) & (rr.real > goal)
        alpha = _guarded(rho, r0v, on)
        a = alpha[:, None]
        s, z = r - a * v, u - a * w
        hu, hw, hy = b.incoming(got, 3, self.systems, self.kind)
        t = z - b.lap(d * z, hu - a * hw) / self.c[:, None]
        q = b.eliminated(d.real, self.c)(t)
        return self.row(block, [phi, x, s, t, y, z, q, w, r0, d], [alpha, rho, goal, on, r00], _flat(_dot(t, s), _dot(t, t), _dot(r0, s), _dot(r0, t), _dot(s, s)), int(on.sum()), b.outgoing(d * z, d * q, d * y, d * w))

    def check(self, b: Block, block, state, got, sums):
        """Back to (phi, x, d), to find the true residual."""
        phi, x, *_, d = self.vectors(state["vectors"], 10)
        goal = self.scalars(state["scalars"])[2]
        return self.row(block, [phi, x, d], [goal], _flat(np.zeros(self.systems)), 0, b.outgoing(d * (phi + x)))


def exchanged(op: DataFrame, state: DataFrame, work, block: type = Block) -> DataFrame:
    """One step: each block meets what its neighbours sent, and the sums of all blocks' dots (one row), and ``work`` makes its next state."""
    mail = state.select(F.explode("out").alias("o")).select(F.col("o.dst").alias("block"), F.struct("o.slots", "o.data").alias("o")).groupBy("block").agg(F.collect_list("o").alias("got"))
    sums = state.select(F.posexplode("dots").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("sums"))
    rows = op.join(state.drop("out", "dots", "open"), "block").join(mail, "block", "left").crossJoin(F.broadcast(sums))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = work(block(row), row["block"], row, row["got"], row["sums"])
                yield pa.RecordBatch.from_pylist([out], schema=TYPES)

    return rows.mapInArrow(run, STATE)


def blocked_solve(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int, tol: float, most: int, stats: dict | None = None, size: int = BLOCK_NODES) -> DataFrame:
    """(fields, filtered) for ``fields`` (keys, node_id, value, k) that cover the mesh; ``stats`` gets the number of iterations."""
    from .solver import SolverNotConvergedError

    blocked = mesh.cache.get(("blocks", size)) or mesh.cache.setdefault(("blocks", size), BlockedMesh(mesh, size))
    return in_batches(blocked.nodes, fields, keys, order, lambda placed: _solve_batch(blocked, placed, order, tol, most, stats, SolverNotConvergedError))


def in_batches(nodes: DataFrame, fields: DataFrame, keys: list[str], order: int, batch) -> DataFrame | None:
    """(fields, filtered) by ``batch``, which gets (_f, node_id, block, value, k) of as many fields as make up to SYSTEMS; None once it has none."""
    names = cut(fields.select(*keys).distinct().withColumn("_f", F.monotonically_increasing_id()), "fields")
    per = max(1, SYSTEMS // len(roots(order)[0]))
    at = fields
    for c in keys:
        at = at.withColumnRenamed(c, f"_k_{c}")
    same = None
    for c in keys:
        one = F.col(f"_k_{c}").eqNullSafe(F.col(c))
        same = one if same is None else same & one
    placed = cut((at.join(names, same) if keys else at.crossJoin(names)).select("_f", "node_id", "value", "k").join(nodes, "node_id").withColumn("_batch", F.floor(F.col("_f") / per)), "fields")
    done = []
    for r in placed.select("_batch").distinct().orderBy("_batch").collect():  # at most fields / per, plus a few
        done.append(batch(placed.filter(F.col("_batch") == r["_batch"])))
        if done[-1] is None:
            return None
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(names, "_f").select(*fields.columns, "filtered")


def _solve_batch(blocked: BlockedMesh, placed: DataFrame, order: int, tol: float, most: int, stats, error) -> DataFrame:
    op, buckets = blocked.op.df, blocked.buckets
    ids = [r["_f"] for r in placed.select("_f").distinct().orderBy("_f").collect()]  # at most SYSTEMS
    steps = Steps(order, len(ids), tol)
    step = lambda state, f: Bucketed(exchanged(op, state.df, f), buckets, dealt=True)
    state, n = steps.start(placed, ids, buckets), 0

    def go(f):
        nonlocal state
        was, state = state, step(state, f)
        was.drop()

    go(steps.send)
    go(steps.begin)
    while True:
        while True:
            go(steps.direction)
            go(steps.descent)
            n_open = state.df.agg(F.max("open")).first()[0]
            if not n_open:
                break
            n += 1
            if n >= most:
                state.drop()
                raise error(f"no convergence in {most} iterations: {n_open} systems of fields {ids[:3]} and on")
        go(steps.check)
        go(steps.begin)
        # the recursive residual may have drifted from the true one: then the same systems go on from there
        goal = np.frombuffer(state.df.select("scalars").first()[0], complex).reshape(-1, steps.systems)[2].real
        rr = _totals(state.df, 5, steps)[4].real
        if (rr <= SLACK**2 * goal).all():
            break
        n += 1
    if stats is not None:
        stats["iterations"] = max(n, stats.get("iterations", 0))

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["ids"], np.int64)
                phi, x, *_ = steps.vectors(row["vectors"], 10)
                yield steps.filtered(ids, nodes, phi, x)

    out = steps.answer(op, state.df, placed, unpack)
    state.drop()
    return out


def _totals(state: DataFrame, count: int, steps: Steps) -> np.ndarray:
    rows = state.select(F.posexplode("dots").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()  # a few numbers for each system
    return steps.sums([r["x"] for r in rows], count)

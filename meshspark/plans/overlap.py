"""Solving (I + 2 (L D)^n) z = phi over overlapping blocks of nodes, for operators too large to broadcast.

A filter's answer to a point falls off by a constant factor with each ring of nodes around it, so a block that is
solved together with some rings of its surroundings nearly has the answer of the whole mesh.  One Spark job a step:
each block takes its neighbours' newest values, finds the true residual on itself and its rings, solves it there
and keeps its own part.  Steps go on until the residual of the whole mesh meets the tolerance; it is never a
recursive one.  Where the scale is so wide that a step does not halve it, there is no answer here, and the
caller takes the tier of ``blocks``.  The n-th power is split into complex systems of order one as there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import PreparedMesh
from ..sources.tables import cut, removed
from .blocks import NEEDS, SENDS, SLACK, STATE, Bucketed, Steps, _address, _flat, _totals, dealt, exchanged, in_batches

OVERLAP_NODES = 16384
RINGS = 16
#: A local solve gains so much, and takes so many iterations at most.
LOCAL_GAIN, LOCAL_STEPS = 1e-8, 100

PATCH = "dst long, src long, ids binary, lengths binary, j binary, s binary, other binary"
REGION = "block long, ids binary, indptr binary, col binary, s binary, region int, halo int"


def _rings(near, start, seeds, rings):
    """The nodes of a block within so many steps of ``seeds``; ``near[start[i] : start[i + 1]]`` are those beside i."""
    seen = np.zeros(len(start) - 1, bool)
    seen[seeds] = True
    now = np.asarray(seeds)
    for _ in range(rings):
        n = start[now + 1] - start[now]
        at = np.repeat(start[now] - np.cumsum(n) + n, n) + np.arange(n.sum())
        now = np.unique(near[at])
        now = now[~seen[now]]
        if not len(now):
            break
        seen[now] = True
    return np.flatnonzero(seen)


def _patches(rings):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's operator rows for itself, and those of its rings beside each neighbour for that one."""
        block = int(pdf["block"].iloc[0])
        i, j, s, other = (pdf[c].to_numpy() for c in ("i", "j", "s", "other"))
        order = np.argsort(i, kind="stable")
        i, j, s, other = i[order], j[order], s[order], other[order]
        ids, row = np.unique(i, return_inverse=True)
        own = other == block
        a, b = row[own], np.searchsorted(ids, j[own])
        a, b = np.concatenate([a, b]), np.concatenate([b, a])  # either direction joins
        by = np.argsort(a, kind="stable")
        near, start = b[by], np.searchsorted(a[by], np.arange(len(ids) + 1))
        first = np.searchsorted(row, np.arange(len(ids) + 1))

        def part(dst, at):
            n = first[at + 1] - first[at]
            e = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return {"dst": int(dst), "src": block, "ids": ids[at].astype(np.int64).tobytes(), "lengths": n.astype(np.int32).tobytes(), "j": j[e].astype(np.int64).tobytes(), "s": s[e].astype(np.float64).tobytes(), "other": other[e].astype(np.int64).tobytes()}

        out = [part(block, np.arange(len(ids)))]
        for dst in np.unique(other[~own]):
            out.append(part(dst, _rings(near, start, np.unique(row[other == dst]), rings)))
        return pd.DataFrame(out)

    return work


def _region(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: the rows of its own nodes and its rings as CSR, the nodes just outside after them, and whom it needs."""
    block = int(pdf["dst"].iloc[0])
    pdf = pdf.assign(far=pdf["src"] != block).sort_values(["far", "src"])
    all_of = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
    ids, lengths, j, s, other = all_of("ids", np.int64), all_of("lengths", np.int32), all_of("j", np.int64), all_of("s", np.float64), all_of("other", np.int64)
    sizes = [len(x) // 8 for x in pdf["ids"]]
    m, own = len(ids), sizes[0]
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], j), m - 1)
    col = order[at]
    rim = ids[col] != j
    outside, first, slot = np.unique(j[rim], return_index=True, return_inverse=True)
    col[rim] = m + slot
    nodes, of = np.concatenate([ids[own:], outside]), np.concatenate([np.repeat(pdf["src"].to_numpy(), sizes)[own:], other[rim][first]])
    needs = []
    for b in np.unique(of):
        k = np.flatnonzero(of == b)
        needs.append({"src": int(b), "nodes": nodes[k].tobytes(), "slots": k.astype(np.int32).tobytes()})
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pd.DataFrame([{"block": block, "ids": ids[:own].tobytes(), "indptr": indptr.tobytes(), "col": col.astype(np.int32).tobytes(), "s": s.tobytes(), "region": m, "halo": len(nodes), "needs": needs}])


class OverlappedMesh:
    """A mesh's operator in overlapping blocks; made once and used by every solve."""

    def __init__(self, mesh: PreparedMesh, size: int = OVERLAP_NODES, rings: int = RINGS):
        self.nodes, rows, self.blocks, self.buckets = dealt(mesh, size)
        patches = rows.groupBy("block").applyInPandas(_patches(rings), PATCH)
        packs = cut(patches.groupBy("dst").applyInPandas(_region, REGION + NEEDS), "mesh-regions")
        needs = packs.select(F.col("block").alias("dst"), F.explode("needs").alias("n")).select("dst", "n.*")
        self.op = Bucketed(packs.groupBy("block").cogroup(needs.groupBy("src")).applyInPandas(_address, REGION + SENDS), self.buckets)
        removed(packs)


class Region:
    """A block with its rings: vectors have its own nodes first, then those of the rings, then those just outside."""

    def __init__(self, row: dict):
        of = lambda c, kind: np.frombuffer(row[c], kind)
        self.indptr, self.col, self.s = of("indptr", np.int32), of("col", np.int32), of("s", np.float64)
        self.own, self.m, self.sends = len(row["ids"]) // 8, row["region"], row["sends"]
        self.size = self.own + row["halo"]
        rows = np.repeat(np.arange(self.m), np.diff(self.indptr))
        at = self.col == rows
        self.diag = np.bincount(rows[at], self.s[at], minlength=self.m)

    def lap(self, x):
        return np.add.reduceat(self.s * x[self.col], self.indptr[:-1])

    def solved(self, r, d, c, goal):
        """x of (x - L(d x) / c) = r inside the region, zero outside it, by BiCGSTAB until x's residual squared is at most ``goal``."""
        wide = np.zeros(self.size, r.dtype)

        def apply(x):
            wide[: self.m] = d * x
            return x - self.lap(wide) / c

        pre = 1 - self.diag * d / c
        x, rr = np.zeros_like(r), np.vdot(r, r).real
        r0, p, rho = r, r, rr
        for _ in range(LOCAL_STEPS):
            if not rr > goal:
                break
            y = p / pre
            v = apply(y)
            along = np.vdot(r0, v)
            if not along:
                break
            a = rho / along
            s = r - a * v
            z = s / pre
            t = apply(z)
            tt = np.vdot(t, t).real
            o = np.vdot(t, s) / tt if tt else 0.0
            r = s - o * t
            rr, now = np.vdot(r, r).real, np.vdot(r0, r)
            if not np.isfinite(rr):
                break
            x = x + a * y + o * z
            beta = now / rho * a / o if o and rho else 0.0
            if not beta or abs(now) ** 2 <= 1e-16 * rr * np.vdot(r0, r0).real:  # orthogonal: start again from here
                r0, p, rho = r, r, rr
            else:
                p, rho = r + beta * (p - o * v), now
        return x

    def outgoing(self, *vectors):
        """What each neighbour needs of the vectors: (places there, values)."""
        out = []
        for send in self.sends:
            at = np.frombuffer(send["at"], np.int32)
            out.append({"dst": send["dst"], "slots": send["slots"], "data": np.stack([v[:, at] for v in vectors]).tobytes()})
        return out

    def take(self, got, kind, *vectors):
        """Neighbours' values into their places."""
        for g in got or []:
            slots = np.frombuffer(g["slots"], np.int32)
            for v, x in zip(vectors, np.frombuffer(g["data"], kind).reshape(len(vectors), len(vectors[0]), len(slots))):
                v[:, self.own + slots] = x


class Overlapped(Steps):
    """``blocks``: how many there are; one whose residual is a hundredth of its share of the goal rests."""

    def __init__(self, order: int, n_fields: int, tol: float, blocks: int):
        super().__init__(order, n_fields, tol)
        self.blocks = blocks

    def send(self, b: Region, block, state, got, sums):
        """From a block's own (phi, x, d): what neighbours need of phi and d."""
        phi, x, d = self.vectors(state["vectors"], 3)
        wide = lambda v: np.concatenate([v, np.zeros((self.systems, b.size - b.own), self.kind)], 1)
        return self.row(block, [wide(phi), wide(x), wide(d)], [np.zeros(self.systems)], _flat(np.zeros(self.systems)), 0, b.outgoing(phi, d))

    def improve(self, first: bool, goal: np.ndarray | None):
        """A step; ``goal`` is the residual squared that the whole mesh must meet in each system."""

        def work(b: Region, block, state, got, sums):
            phi, x, d = (v.copy() for v in self.vectors(state["vectors"], 3))
            b.take(got, self.kind, *([phi, d] if first else [x]))
            rr = np.zeros(self.systems)
            for f, c in enumerate(self.c):
                r = b.lap(d[f] * (phi[f] + x[f])) / c - x[f, : b.m]
                rr[f] = np.vdot(r[: b.own], r[: b.own]).real
                here = np.vdot(r, r).real
                least = 0.0 if goal is None else goal[f] * 0.01 / self.blocks
                if here > least:
                    x[f, : b.own] += b.solved(r, d[f, : b.m].real, c, max(least, here * LOCAL_GAIN**2))[: b.own]
            return self.row(block, [phi, x, d], [np.zeros(self.systems)], _flat(rr), 0, b.outgoing(x))

        return work


def overlapped_solve(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int, tol: float, most: int, stats: dict | None = None, size: int = OVERLAP_NODES, rings: int = RINGS) -> DataFrame | None:
    """(fields, filtered) for ``fields`` (keys, node_id, value, k) that cover the mesh, or None where the scale is too wide."""
    made = mesh.cache.get(("overlap", size, rings)) or mesh.cache.setdefault(("overlap", size, rings), OverlappedMesh(mesh, size, rings))
    return in_batches(made.nodes, fields, keys, order, lambda placed: _solve_batch(made, placed, order, tol, most, stats))


def _solve_batch(made: OverlappedMesh, placed: DataFrame, order: int, tol: float, most: int, stats) -> DataFrame | None:
    op = made.op.df
    ids = [r["_f"] for r in placed.select("_f").distinct().orderBy("_f").collect()]  # at most SYSTEMS
    steps = Overlapped(order, len(ids), tol, made.blocks)
    state = steps.start(placed, ids, made.buckets)

    def go(f):
        nonlocal state
        was, state = state, Bucketed(exchanged(op, state.df, f, Region), made.buckets, dealt=True)
        was.drop()

    go(steps.send)
    goal = last = None
    for n in range(most + 1):
        go(steps.improve(n == 0, goal))
        rr = _totals(state.df, 1, steps)[0].real  # of the values before this step
        if not np.isfinite(rr).all():
            raise ValueError("a field, a scale or the operator holds a value that is not finite")
        goal = rr * tol**2 if goal is None else goal
        open_ = rr > goal
        if not open_.any():
            break
        if last is not None and (rr > last / 4)[open_].any():
            if (rr <= SLACK**2 * goal).all():  # as exact as the arithmetic is
                break
            state.drop()
            return None
        last = rr
    else:
        state.drop()
        return None
    if stats is not None:
        stats["steps"] = max(n, stats.get("steps", 0))

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["ids"], np.int64)
                phi, x, _ = (v[:, : len(nodes)] for v in steps.vectors(row["vectors"], 3))
                yield steps.filtered(ids, nodes, phi, x)

    out = steps.answer(op, state.df, placed, unpack)
    state.drop()
    return out

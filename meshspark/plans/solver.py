"""Solving (I + 2 (L D)^n) z = phi for many right-hand sides.

``local``: an operator of checked size is broadcast as CSR and every right-hand side is solved in the
task that holds it, so work scales with the number of fields.  ``distributed``: conjugate gradients
as DataFrame steps for operators beyond that size, all right-hand sides advancing together.
``blocks``: stabilised biconjugate gradients over blocks of nodes, for operators of any size, symmetric or not.
``overlap``: blocks solved with rings of their surroundings, for scales of up to some ten cells; ``blocks`` beyond that.
``spectral``: fast cosine transforms of lines on a closed uniform grid.  ``auto`` takes ``local`` up to LOCAL_ENTRIES
entries, then ``spectral`` where the mesh is such a grid and each field has one scale, else ``overlap``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import PreparedMesh
from ..sources.tables import cut, removed
from .blocks import blocked_solve
from .overlap import overlapped_solve

#: Entries of an operator that may be broadcast (about 24 bytes each).
LOCAL_ENTRIES = 4_000_000
TOLERANCE, MAX_ITERATIONS = 1e-11, 150_000


class SolverNotConvergedError(RuntimeError):
    """A right-hand side did not reach the tolerance."""


class Csr:
    def __init__(self, ids: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray):
        self.ids, n = ids, len(ids)
        at = lambda x: np.searchsorted(ids, x)
        # a zero on every diagonal keeps all rows non-empty, which reduceat needs
        i, j, s = np.concatenate([at(i), np.arange(n)]), np.concatenate([at(j), np.arange(n)]), np.concatenate([s, np.zeros(n)])
        order = np.lexsort((j, i))
        self.j, self.s = j[order], s[order]
        self.start = np.searchsorted(i[order], np.arange(n))
        self.diag = np.bincount(i[i == j], s[i == j], minlength=n)

    def dot(self, x):
        return np.add.reduceat(self.s * x[self.j], self.start)


def solve_one(m: Csr, area, d, phi, order: int, symmetric: bool, tol: float = TOLERANCE, most: int = MAX_ITERATIONS) -> np.ndarray:
    """The filtered field; ``d`` is 1 / k^2 on every node."""

    def apply(x):
        y = x
        for _ in range(order):
            y = m.dot(d * y)
        return x + 2 * y

    rhs = phi - apply(phi)
    size = np.sqrt(rhs @ rhs)
    if size == 0:
        return phi.copy()
    pre = 1 + 2 * (m.diag * d) ** order
    if symmetric:
        w = np.sqrt(area * d)  # the symmetrised operator W M W^-1
        x, r = np.zeros_like(phi), w * rhs
        goal = tol * np.sqrt(r @ r)
        z = r / pre
        p, rz = z.copy(), r @ z
        for _ in range(most):
            q = w * apply(p / w)
            a = rz / (p @ q)
            x, r = x + a * p, r - a * q
            if np.sqrt(r @ r) <= goal:
                return phi + x / w
            z = r / pre
            rz, was = r @ z, rz
            p = z + rz / was * p
    else:
        x, r = np.zeros_like(phi), rhs.copy()
        r0, rho, a, o, v, p = r.copy(), 1.0, 1.0, 1.0, np.zeros_like(r), np.zeros_like(r)
        for _ in range(most):
            was, rho = rho, r0 @ r
            if rho == 0 or o == 0:  # broke down: start again from here
                r = rhs - apply(x)
                r0, rho, was, a, o, v, p = r.copy(), r @ r, 1.0, 1.0, 1.0, np.zeros_like(r), np.zeros_like(r)
            p = r + rho / was * a / o * (p - o * v)
            y = p / pre
            v = apply(y)
            a = rho / (r0 @ v)
            s = r - a * v
            z = s / pre
            t = apply(z)
            o = (t @ s) / (t @ t) if t @ t else 0.0
            x, r = x + a * y + o * z, s - o * t
            if np.sqrt(r @ r) <= tol * size:
                return phi + x
    raise SolverNotConvergedError(f"no convergence in {most} iterations")


def broadcast_csr(mesh: PreparedMesh):
    """(the operator as broadcast CSR with areas, or None beyond LOCAL_ENTRIES; its entries), made once for a mesh."""
    made = mesh.cache.get("csr")
    if made is None or (made[0] is None) != (made[1] > LOCAL_ENTRIES):
        n, shared = mesh.node.count(), None
        if n > LOCAL_ENTRIES // 16:
            mesh.write()
            n = max(n, mesh.operator.count())
        if n <= LOCAL_ENTRIES:
            op = mesh.operator.select("i", "j", "s").limit(LOCAL_ENTRIES + 1).toArrow()
            node = mesh.node.select("node_id", "area").toArrow().sort_by("node_id")
            n = max(op.num_rows, node.num_rows)
        if n <= LOCAL_ENTRIES:
            csr = Csr(node.column("node_id").to_numpy(), *[op.column(c).to_numpy() for c in "ijs"])
            shared = mesh.node.sparkSession.sparkContext.broadcast((csr, node.column("area").to_numpy(), mesh.symmetric))
        made = mesh.cache["csr"] = (shared, n)
    return made


def local_solve(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int, scale: DataFrame | None = None, tol: float = TOLERANCE, most: int = MAX_ITERATIONS) -> DataFrame:
    """``fields`` is (keys, node_id, value, k); one task solves one right-hand side."""
    shared = broadcast_csr(mesh)[0]

    def work(pdf):
        m, area, symmetric = shared.value
        at = np.searchsorted(m.ids, pdf["node_id"].to_numpy())
        if len(at) != len(m.ids) or (m.ids[np.minimum(at, len(m.ids) - 1)] != pdf["node_id"].to_numpy()).any():
            raise ValueError(f"field {dict(pdf[keys].iloc[0])} does not cover the mesh's nodes once each")
        phi, d = np.empty(len(at)), np.empty(len(at))
        phi[at], d[at] = pdf["value"].to_numpy(), 1 / pdf["k"].to_numpy() ** 2
        try:
            out = solve_one(m, area, d, phi, order, symmetric, tol, most)
        except SolverNotConvergedError as e:
            raise SolverNotConvergedError(f"{dict(pdf[keys].iloc[0])}: {e}") from e
        return pdf.assign(filtered=out[at])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.schema) + ", filtered double"
    return fields.groupBy(*keys).applyInPandas(work, schema)


def _check_cover(mesh: PreparedMesh, fields: DataFrame, keys: list[str]) -> None:
    """Every field has a value on each of the mesh's nodes, once, and on no other node, as in the local tier."""
    n = mesh.node.count()
    at = fields.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("n")).join(mesh.node.select("node_id", F.lit(1).alias("known")), "node_id", "left")
    bad = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.count("known").alias("known"), F.max("n").alias("n")).filter((F.col("nodes") != n) | (F.col("known") != n) | (F.col("n") > 1)).first()
    if bad:
        raise ValueError(f"field { {k: bad[k] for k in keys} } does not cover the mesh's nodes once each")


def distributed_solve(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int, tol: float = TOLERANCE, most: int = MAX_ITERATIONS) -> DataFrame:
    """The same by conjugate gradients over DataFrames; needs a symmetric area-weighted operator.

    Tolerance, iteration limit, preconditioner and coverage are the local tier's.  Each iteration is
    ``order`` joins with the operator and two small aggregates; state is cut to the shared folder, past
    states are removed from it, and right-hand sides that have converged stop moving.
    """
    if not mesh.symmetric:
        raise ValueError("conjugate gradients need a symmetric area-weighted operator")
    _check_cover(mesh, fields, keys)
    op = cut(mesh.operator.select("i", "j", "s").repartition("j"), "operator")
    diag = op.filter("i = j").groupBy(F.col("i").alias("node_id")).agg(F.sum("s").alias("_diag"))
    pre = 1 + 2 * F.pow(F.coalesce("_diag", F.lit(0.0)) / (F.col("k") * F.col("k")), F.lit(order))
    base = fields.join(mesh.node.select("node_id", "area"), "node_id").join(diag, "node_id", "left").withColumn("pre", pre).drop("_diag").withColumn("w", F.sqrt("area") / F.col("k"))
    on = [*keys, "node_id"]

    def lap(df, c):
        """(keys, node_id, y): (L D)^order applied to column c."""
        cur = df.select(*on, "k", F.col(c).alias("y"))
        for _ in range(order):
            d = cur.select(*keys, F.col("node_id").alias("j"), (F.col("y") / (F.col("k") * F.col("k"))).alias("y"))
            s = d.join(op, "j").groupBy(*keys, F.col("i").alias("node_id")).agg(F.sum(F.col("s") * F.col("y")).alias("_s"))
            cur = cur.select(*on, "k").join(s, on, "left").withColumn("y", F.coalesce("_s", F.lit(0.0))).drop("_s")
        return cur.select(*on, "y")

    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    start = cut(base.join(lap(base.withColumn("_v", F.col("value")), "_v"), on).withColumn("r", -2 * F.col("w") * F.col("y")).drop("y"), "cg")
    sizes = start.groupBy(*keys).agg(dot("r", "r").alias("rr"))
    goal = {tuple(r[k] for k in keys): r["rr"] * tol * tol for r in sizes.collect()}
    rr = {k: v / (tol * tol) if tol else v for k, v in goal.items()}
    limits = sizes.select(*keys, (F.col("rr") * tol * tol).alias("goal"))
    state = cut(start.join(F.broadcast(limits), keys).withColumn("x", F.lit(0.0)).withColumn("p", F.col("r") / F.col("pre")), "cg")  # one row for each field
    removed(start)
    for step in range(most + 1):
        open_ = [k for k in goal if rr[k] > goal[k] and rr[k] > 0]
        if not open_:
            return state.select(*fields.columns, (F.col("value") + F.col("x") / F.col("w")).alias("filtered"))
        if step == most:
            break
        pv = state.withColumn("_v", F.col("p") / F.col("w"))
        q = cut(state.join(lap(pv, "_v"), on).withColumn("q", F.col("p") + 2 * F.col("w") * F.col("y")).drop("y"), "cg")
        small = q.withColumn("z", F.col("r") / F.col("pre")).groupBy(*keys).agg(dot("r", "z").alias("rz"), dot("p", "q").alias("pq"), (dot("r", "r") > F.first("goal")).alias("moves"))
        small = small.select(*keys, "rz", F.when(F.col("moves") & (F.col("pq") > 0), F.col("rz") / F.col("pq")).otherwise(F.lit(0.0)).alias("a"))
        moved = q.join(F.broadcast(small), keys)  # one row for each field
        moved = cut(moved.withColumn("x", F.col("x") + F.col("a") * F.col("p")).withColumn("r", F.col("r") - F.col("a") * F.col("q")), "cg")
        fresh = moved.withColumn("z", F.col("r") / F.col("pre")).groupBy(*keys).agg(dot("r", "z").alias("new"), dot("r", "r").alias("rr"))
        rr = {tuple(r[k] for k in keys): r["rr"] for r in fresh.collect()}
        turn = F.when(F.col("rz") > 0, F.col("new") / F.col("rz")).otherwise(F.lit(0.0))
        after = cut(moved.join(F.broadcast(fresh.drop("rr")), keys).withColumn("p", F.col("r") / F.col("pre") + turn * F.col("p")).drop("a", "q", "rz", "new"), "cg")
        for past in (state, q, moved):
            removed(past)
        state = after
    raise SolverNotConvergedError(f"no convergence in {most} iterations: {open_[:3]}")


def cosines(v: np.ndarray) -> np.ndarray:
    """Orthonormal cosine transform of each row, by a fast Fourier transform of its even continuation."""
    n = v.shape[1]
    p = np.arange(n)
    c = (np.fft.rfft(np.concatenate([v, v[:, ::-1]], 1))[:, :n] * np.exp(-1j * np.pi * p / (2 * n))).real / 2
    return c * np.sqrt(np.where(p == 0, 1.0, 2.0) / n)


def from_cosines(c: np.ndarray) -> np.ndarray:
    n = c.shape[1]
    p = np.arange(n)
    a = c * np.sqrt(np.where(p == 0, 1.0, 2.0) / n) * np.exp(1j * np.pi * p / (2 * n))
    return np.fft.ifft(a, 2 * n)[:, :n].real * 2 * n


def spectral_solve(cells: DataFrame, fields: DataFrame, keys: list[str], nx: int, ny: int, k, order: int, area: float = 1.0) -> DataFrame:
    """Closed uniform grid: fast cosine transforms of its lines; ``fields`` is (keys, ix, iy, value), ``k`` a number or a column of the keys.

    A line of cells is a row, transformed in its task; each cell moves three times, to its column, to its row of modes and back.
    """

    def lines(df, by, along):
        each = F.array_sort(F.collect_list(F.struct(F.col(along).alias("a"), F.col("value").alias("v"))))
        return df.groupBy(*keys, by).agg(each.alias("l")).select(*keys, by, F.col("l.v").alias("line"))

    def mapped(df, by, work):
        def run(frames):
            for pdf in frames:
                if len(pdf):
                    pdf["line"] = list(work(np.stack([np.asarray(v) for v in pdf["line"]]), pdf))
                yield pdf

        return df.mapInPandas(run, df.schema)

    def respond(v, pdf):
        e = 4 * np.sin(np.pi * np.arange(nx) / (2 * nx)) ** 2 + 4 * np.sin(np.pi * pdf["r"].to_numpy()[:, None] / (2 * ny)) ** 2
        return from_cosines(cosines(v) / (1 + 2 * (e / area / pdf["_k"].to_numpy()[:, None] ** 2) ** order))

    spread = lambda df, keep, to: df.select(*keys, keep, F.posexplode("line").alias(to, "value"))
    columns = mapped(lines(fields.select(*keys, "ix", "iy", "value"), "ix", "iy"), "ix", lambda v, _: cosines(v))
    modes = lines(spread(columns, "ix", "r"), "r", "ix").withColumn("_k", k if not isinstance(k, (int, float)) else F.lit(float(k)))
    low = mapped(modes, "r", respond).drop("_k")
    back = mapped(lines(spread(low, "r", "ix"), "ix", "r"), "ix", lambda v, _: from_cosines(v))
    return spread(back, "ix", "iy").withColumnRenamed("value", "filtered")


def _spectral(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int) -> DataFrame:
    """``spectral_solve`` for rows by node id, held to the coverage of the other tiers."""
    nx, ny, area = mesh.grid
    _check_cover(mesh, fields, keys)
    at = fields.withColumn("ix", F.floor(F.col("node_id") / ny).cast("int")).withColumn("iy", (F.col("node_id") % ny).cast("int"))
    out = spectral_solve(None, at, [*keys, "k"], nx, ny, F.col("k"), order, area)
    out = out.select(*keys, (F.col("ix") * ny + F.col("iy")).cast("long").alias("node_id"), "filtered")
    return fields.join(out, [*keys, "node_id"]).select(*fields.columns, "filtered")


def _one_scale(fields: DataFrame, keys: list[str]) -> bool:
    return fields.groupBy(*keys).agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a <> b").isEmpty()


def solve(mesh: PreparedMesh, fields: DataFrame, keys: list[str], order: int, solver: str = "auto", tol: float = TOLERANCE, most: int = MAX_ITERATIONS) -> DataFrame:
    """(fields, filtered) by the tier named; ``local`` raises for an operator beyond LOCAL_ENTRIES."""
    if order < 1:
        raise ValueError("the order must be at least 1")
    if solver not in ("auto", "local", "distributed", "overlap", "blocks", "spectral"):
        raise NotImplementedError(f"solver {solver!r}")
    if solver == "spectral" and not (mesh.grid and _one_scale(fields, keys)):
        raise ValueError("cosine transforms need a closed uniform grid and one scale for each field")
    if solver in ("auto", "local"):
        if broadcast_csr(mesh)[0] is not None:
            return local_solve(mesh, fields, keys, order, tol=tol, most=most)
        if solver == "local":
            raise ValueError(f"the operator has more than {LOCAL_ENTRIES} entries")
        solver = "spectral" if mesh.grid and _one_scale(fields, keys) else "overlap"
    if solver == "spectral":
        return _spectral(mesh, fields, keys, order)
    if solver in ("overlap", "blocks"):
        _check_cover(mesh, fields, keys)
        out = overlapped_solve(mesh, fields, keys, order, tol, min(most, 100)) if solver == "overlap" else None
        return out if out is not None else blocked_solve(mesh, fields, keys, order, tol, most)
    return distributed_solve(mesh, fields, keys, order, tol, most)

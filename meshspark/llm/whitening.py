"""Whitening of embeddings by a one-sided Jacobi SVD of a tall, skinny QR factor.

Entries become whole numbers, so means and deviations are exact.  Each distinct vector once makes the
fit list.  Tasks reduce centred blocks of it to triangular factors R, which meet in a tree whose nodes
take ``FAN`` of them each; the last R is as wide as a vector, whatever the rows.  Plane rotations
orthogonalise R's columns; their accumulation holds the components and the columns' lengths the
standard deviations, without squaring the data.

Defined cases: vectors that are null or hold a null, an infinity or no number are left out, as are
those not of the commonest length (the longest of these); null and repeated ids are rows of their
own; directions in which the fit list does not vary to double precision are no components, so fewer
than ``most`` may come and a table of equal vectors, or an empty one, gives no rows; a deviation beyond a long is null;
columns are addressed by name and others ignored.  ``n`` and ``deviation`` are exact whatever the partitions, components to rounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
FAN = 32
ROWS = 4096
SWEEPS = 60


def whole_numbers(c: str) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector takes no part."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(c, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long") + SHIFT))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in longs where they suffice, else in Python's numbers."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums.astype(object)


def deviations(c: np.ndarray) -> list:
    """Sum of squares of each row, or None beyond a long."""
    top = int(np.abs(c).max(initial=0))
    if c.dtype != object and top * top * c.shape[1] < 1 << 63:
        return (c * c).sum(1).tolist()
    each = [sum(int(v) * int(v) for v in row) for row in c]
    return [d if d < 1 << 63 else None for d in each]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column lengths falling, their unit vectors as columns) of r's right singular system.

    A sweep turns all pairs of columns, in rounds of disjoint pairs, until all are orthogonal to rounding.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    ring = np.arange(d + d % 2)
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = ring[:half], ring[::-1][:half]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, off.max(initial=0))
            turn = off > eps
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            vx, vy = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vx - s * vy, s * vx + c * vy
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= 4 * eps * d:
            break
    length = np.sqrt((a * a).sum(0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


def _matrices(column) -> np.ndarray:
    return np.stack([np.asarray(v) for v in column])


def _block_factors(n: int, sums: np.ndarray):
    def work(frames):
        r, held, rows = None, [], 0
        for pdf in frames:
            if not len(pdf):
                continue
            held.append(centred(_matrices(pdf["x"]), n, sums).astype(np.float64) / n)
            rows += len(pdf)
            if rows >= ROWS:
                r, held, rows = np.linalg.qr(np.concatenate([*([] if r is None else [r]), *held]), "r"), [], 0
        if held:
            r = np.linalg.qr(np.concatenate([*([] if r is None else [r]), *held]), "r")
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    return work


def tall_skinny_factor(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit list (n rows of ``x``), by a tree of QR factorisations."""
    d = len(sums)
    kind = "part long, r array<double>"
    block = _block_factors(n, sums)

    def first(frames):
        for out in block(frames):
            yield out.assign(part=_task())

    def meet(pdf):
        rows = [np.asarray(r).reshape(-1, d) for r in pdf.sort_values("part")["r"]]
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "r": [np.linalg.qr(np.concatenate(rows), "r").ravel().tolist()]})

    at = written(fit.mapInPandas(first, kind), "whiten-r")
    while at.count() > FAN:
        at = written(at.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(meet, kind), "whiten-r")
    last = [np.asarray(r["r"]).reshape(-1, d) for r in at.orderBy("part").collect()]  # at most FAN, of d x d
    return np.linalg.qr(np.concatenate(last), "r")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _projector(n: int, sums: np.ndarray, components: np.ndarray, deviation: np.ndarray):
    def project(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums).astype(np.float64) / n) @ components / deviation

    return project


def _identity_error(fit: DataFrame, project, k: int, n: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity; a task sends k (k + 1) sums."""

    def work(frames):
        gram, total = np.zeros((k, k)), np.zeros(k)
        for pdf in frames:
            if len(pdf):
                w = project(_matrices(pdf["x"]))
                gram, total = gram + w.T @ w, total + w.sum(0)
        i, j = np.divmod(np.arange(k * (k + 1)), k)
        yield pd.DataFrame({"i": i, "j": j, "s": np.concatenate([gram.ravel(), total])})

    sums = np.zeros((k + 1, k))
    for r in fit.mapInPandas(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k (k + 1) rows
        sums[r["i"], r["j"]] = r["s"]
    mean = sums[k] / n
    return float(np.abs(sums[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = rows.sparkSession
    kind = "long" if id_col not in rows.columns else rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = rows.select(F.col(id_col), whole_numbers(vector_col).alias("x")).filter("size(x) > 0")
    data = written(x, "whiten-x")
    width = data.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if width is None:
        return spark.createDataFrame([], schema)
    d = width["d"]
    data = data.filter(F.size("x") == d)
    fit = written(data.select("x").distinct(), "whiten-fit")
    top = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = top["n"], np.array([int(top[f"s{i}"]) for i in range(d)], object)
    length, v = jacobi(tall_skinny_factor(fit, n, sums))
    k = int(min(most, (length > length[0] * d * 16 * np.finfo(float).eps).sum())) if length[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    variance = length**2 / n
    explained = (variance / variance.sum())[:k]
    project = _projector(n, sums, v[:, :k], np.sqrt(variance[:k]))
    error = _identity_error(fit, project, k, n)

    def work(frames):
        for pdf in frames:
            if len(pdf):
                x = _matrices(pdf["x"])
                far = deviations(centred(x, n, sums))
                yield pd.DataFrame(
                    {
                        id_col: pdf[id_col].repeat(k).to_numpy(),
                        "component": np.tile(np.arange(1, k + 1), len(pdf)),
                        "n": n,
                        "deviation": pd.array([f for f in far for _ in range(k)], "Int64"),
                        "whitened": project(x).ravel(),
                        "explained": np.tile(explained, len(pdf)),
                        "identity_error": error,
                    }
                )

    return data.mapInPandas(work, schema)

"""Sparse operators as (i, j, s) rows, positive sign: assembled by one aggregation, applied by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(geometry: DataFrame, value) -> DataFrame:
    """Nine rows for each element: node pairs with ``value(row corner, column corner)``."""
    block = F.array(*[F.struct(F.col(f"n{a}").alias("i"), F.col(f"n{b}").alias("j"), value(a, b).alias("s")) for a in range(3) for b in range(3)])
    return geometry.select(F.explode(block).alias("b")).select("b.i", "b.j", "b.s")


def _stiffness_value(a, b):
    return (F.col(f"dx{a}") * F.col(f"dx{b}") + F.col(f"dy{a}") * F.col(f"dy{b}")) * F.col("elem_area")


def summed(triples: DataFrame) -> DataFrame:
    """Duplicate entries add up."""
    return triples.groupBy("i", "j").agg(F.sum("s").alias("s"))


def rows_by_area(operator: DataFrame, areas: DataFrame) -> DataFrame:
    return operator.join(areas.select(F.col("node_id").alias("i"), "area"), "i").select("i", "j", (F.col("s") / F.col("area")).alias("s"))


def stiffness(geometry: DataFrame, areas: DataFrame) -> DataFrame:
    """The Laplacian of a triangular mesh, rows divided by node area; symmetric before that, so a pair is summed once and mirrored."""
    half = F.array(*[F.struct(F.least(f"n{a}", f"n{b}").alias("i"), F.greatest(f"n{a}", f"n{b}").alias("j"), _stiffness_value(a, b).alias("s")) for a in range(3) for b in range(a, 3)])
    once = summed(geometry.select(F.explode(half).alias("b")).select("b.i", "b.j", "b.s"))
    there, back = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = once.select("s", F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))).alias("p"))
    return rows_by_area(both.select("p.i", "p.j", "s"), areas)


def metric_block(geometry: DataFrame, areas: DataFrame, n: int) -> DataFrame:
    """[[S, G], [-G, S]] over (u, v), the second component's ids shifted by ``n``, rows divided by area."""
    own = lambda a, b: _stiffness_value(a, b) + (F.col("mt") * F.col("mt") * F.col("elem_area") / 3 if a == b else F.lit(0.0))
    s = rows_by_area(summed(_pairs(geometry, own)), areas)
    g = rows_by_area(summed(_pairs(geometry, lambda a, b: F.col("mt") * (F.col(f"dx{a}") - F.col(f"dx{b}")) * F.col("elem_area") / 3)), areas)
    put = lambda d, di, dj, sign: d.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), (sign * F.col("s")).alias("s"))
    return put(s, 0, 0, 1).unionByName(put(g, 0, n, 1)).unionByName(put(g, n, 0, -1)).unionByName(put(s, n, n, 1))


def closed(off: DataFrame) -> DataFrame:
    """Off-diagonal weights (i, j, s > 0) as a positive operator: minus the weights, and their sum on the diagonal."""
    return summed(off.select("i", "j", (-F.col("s")).alias("s")).unionByName(off.select("i", F.col("i").alias("j"), "s")))


def _sided(neighbours: DataFrame, metrics: DataFrame, what: str):
    return F.element_at(F.array(*[F.col(f"{what}{k}") for k in range(4)]), F.col("dir") + 1)


def latlon_operator(neighbours: DataFrame, metrics: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(hc / hh) / area to every ocean neighbour; ``cells`` gives (cell_id, ocean) where there is land."""
    e = neighbours.join(metrics, "cell_id")
    if cells is not None:
        e = e.join(cells.filter("ocean").select(F.col("cell_id").alias("nbr_id")), "nbr_id", "left_semi")
    off = e.select(F.col("cell_id").alias("i"), F.col("nbr_id").alias("j"), (_sided(e, metrics, "hc") / _sided(e, metrics, "hh") / F.col("area")).alias("s"))
    return closed(off) if cells is None else masked(closed(off), cells.filter("ocean").select(F.col("cell_id").alias("node_id")))


def uniform_operator(neighbours: DataFrame, area: float = 1.0) -> DataFrame:
    return closed(neighbours.select(F.col("cell_id").alias("i"), F.col("nbr_id").alias("j"), F.lit(1.0 / area).alias("s")))


def nemo_operator(neighbours: DataFrame, metrics: DataFrame, cells: DataFrame) -> DataFrame:
    """hh h3(q) / (hc h3t(q)) / area to every ocean neighbour q; u heights for W and E, v heights for N and S."""
    at = cells.select(F.col("cell_id").alias("nbr_id"), "e3u", "e3v", "e3t", F.col("ocean").alias("q_ocean"))
    e = neighbours.filter("nbr_id <> cell_id").join(metrics, "cell_id").join(at, "nbr_id").filter("q_ocean")
    h3 = F.when(F.col("dir") % 2 == 0, F.col("e3u")).otherwise(F.col("e3v"))
    off = e.select(F.col("cell_id").alias("i"), F.col("nbr_id").alias("j"), (_sided(e, metrics, "hh") * h3 / (_sided(e, metrics, "hc") * F.col("e3t")) / F.col("area")).alias("s"))
    return masked(closed(off), cells.filter("ocean").select(F.col("cell_id").alias("node_id")))


def masked(operator: DataFrame, ocean: DataFrame) -> DataFrame:
    """Only entries with both ends in ``ocean`` (node_id): elsewhere the filter is the identity."""
    return operator.join(ocean.select(F.col("node_id").alias("i")), "i", "left_semi").join(ocean.select(F.col("node_id").alias("j")), "j", "left_semi")


def matvec(operator: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) = sum of s * x[j]; ``x`` is (node_id, value)."""
    return operator.join(x.select(F.col("node_id").alias("j"), "value"), "j").groupBy("i").agg(F.sum(F.col("s") * F.col("value")).alias("y"))


def columns_scaled(operator: DataFrame, scale: DataFrame) -> DataFrame:
    """Columns times 1 / k^2; ``scale`` is (node_id, k)."""
    return operator.join(scale.select(F.col("node_id").alias("j"), "k"), "j").select("i", "j", (F.col("s") / (F.col("k") * F.col("k"))).alias("s"))


def diagonal(operator: DataFrame) -> DataFrame:
    return operator.filter("i = j").select(F.col("i").alias("node_id"), F.col("s").alias("d"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sparse product of two operators: a join on the inner index and one aggregation."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("s").alias("_s"))
    return a.join(right, a["j"] == right["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("s") * F.col("_s")).alias("s"))


def power(operator: DataFrame, n: int) -> DataFrame:
    """The n-th power as a matrix, by squaring; its ``diagonal`` is that of the filter's operator of order n."""
    if n < 1:
        raise ValueError("the power must be at least 1")
    out, square = None, operator
    while n:
        if n & 1:
            out = square if out is None else product(out, square)
        n >>= 1
        if n:
            square = product(square, square)
    return out

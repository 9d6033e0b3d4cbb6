"""Topology: who touches whom, as joins and aggregates over incidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lattice(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Two triangles for each quad of an nx x ny node lattice; node id = column * ny + row."""
    q = F.col("id") % (ny - 1)
    n = F.floor(F.col("id") / (ny - 1))
    at = lambda dq, dn: (n + dn) * ny + q + dq
    pair = F.array(F.array(at(0, 0), at(1, 0), at(0, 1)), F.array(at(1, 0), at(1, 1), at(0, 1)))
    return spark.range((nx - 1) * (ny - 1)).select("id", F.posexplode(pair).alias("half", "nodes")).select((2 * F.col("id") + F.col("half")).alias("elem_id"), F.col("nodes").cast("array<bigint>").alias("nodes"))


def lattice_over(nodes: DataFrame, ny: int, n: int) -> DataFrame:
    """The same over rows (node_id, ix, iy) of n nodes in columns of ``ny``; a last column that is not full has no quads."""
    at = lambda dq, dn: F.col("node_id") + dn * ny + dq
    pair = F.array(F.array(at(0, 0), at(1, 0), at(0, 1)), F.array(at(1, 0), at(1, 1), at(0, 1)))
    quads = nodes.filter((F.col("iy") < ny - 1) & (F.col("node_id") + ny + 1 < n))
    return quads.select((F.col("ix") * (ny - 1) + F.col("iy")).alias("q"), F.posexplode(pair).alias("half", "nodes")).select((2 * F.col("q") + F.col("half")).alias("elem_id"), F.col("nodes").cast("array<bigint>").alias("nodes"))


def incidence(elements: DataFrame) -> DataFrame:
    """(elem_id, k, node_id): one row for each corner."""
    return elements.select("elem_id", F.posexplode("nodes").alias("k", "node_id"))


def elements_per_node(elements: DataFrame) -> DataFrame:
    return incidence(elements).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_elems"))


def node_elements(elements: DataFrame) -> DataFrame:
    """(node_id, elems): incident elements in element order; a mesh node has few."""
    return incidence(elements).groupBy("node_id").agg(F.array_sort(F.collect_list("elem_id")).alias("elems"))


def neighbour_pairs(elements: DataFrame) -> DataFrame:
    """(node_id, nbr_id, first_elem, first_k): nodes that share an element, self included, with where they were first seen."""
    a = incidence(elements)
    b = a.select("elem_id", F.col("k").alias("nbr_k"), F.col("node_id").alias("nbr_id"))
    return a.join(b, "elem_id").groupBy("node_id", "nbr_id").agg(F.min(F.struct("elem_id", "nbr_k")).alias("first")).select("node_id", "nbr_id", F.col("first.elem_id").alias("first_elem"), F.col("first.nbr_k").alias("first_k"))


def node_neighbours(elements: DataFrame) -> DataFrame:
    """(node_id, nbrs): neighbours in first-seen order."""
    return neighbour_pairs(elements).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("first_elem", "first_k", "nbr_id"))).alias("l")).select("node_id", F.col("l.nbr_id").alias("nbrs"))


def date_line_free(elements: DataFrame, nodes: DataFrame, widest: float = 10.0) -> DataFrame:
    """(elem_id, nodes): elements whose longitudes (degrees) span less than ``widest``; others cross the date line."""
    span = incidence(elements).join(nodes.select("node_id", "x"), "node_id").groupBy("elem_id").agg((F.max("x") - F.min("x")).alias("span"))
    return elements.join(span.filter(F.col("span") < widest).select("elem_id"), "elem_id", "left_semi")


def grid_cells(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    return spark.range(nx * ny).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % ny).cast("int").alias("iy"))


def grid_neighbours(cells: DataFrame, nx: int, ny: int, kind: str = "local", fold: DataFrame | None = None) -> DataFrame:
    """(cell_id, dir, nbr_id), dir 0 W, 1 N, 2 E, 3 S; a missing row is a missing neighbour.

    ``local`` is closed, ``periodic`` wraps in x, ``fold`` also joins the top row to itself through
    ``fold`` (ref_x, adjacent_x; columns numbered from 1).  Neighbours are id arithmetic: no shuffle.
    """
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs two cells each way")
    if kind not in ("local", "periodic", "fold"):
        raise NotImplementedError(kind)
    cell, ix, iy = F.col("cell_id"), F.col("ix"), F.col("iy")
    top = None
    if kind == "fold":
        # one row for each column of the grid
        cells = cells.join(F.broadcast(fold.select((F.col("ref_x") - 1).cast("int").alias("ix"), F.col("adjacent_x"))), "ix", "left")
        top = (F.col("adjacent_x") * ny - 1).cast("long")
    if kind == "local":
        west, east = F.when(ix > 0, cell - ny), F.when(ix < nx - 1, cell + ny)
    else:
        west, east = (F.pmod(ix - 1, F.lit(nx)) * ny + iy).cast("long"), (F.pmod(ix + 1, F.lit(nx)) * ny + iy).cast("long")
    north = F.when(iy < ny - 1, cell + 1) if top is None else F.when(iy < ny - 1, cell + 1).otherwise(F.when(top != cell, top))
    south = F.when(iy > 0, cell - 1)
    return cells.select("cell_id", F.posexplode(F.array(west, north, east, south)).alias("dir", "nbr_id")).filter("nbr_id is not null")


def north_fold(points: DataFrame, precision: float = 1e-5) -> tuple[DataFrame, int]:
    """The fold of a curvilinear grid from (x, y, lon): (ref_x, adjacent_x), and the row (-2 or -3) it matches.

    The last row is compared with the two candidates as sorted rows; columns pair on equal integer
    longitudes in x order; outlying jumps go, and a line through the rest names every column's partner.
    """
    size = points.agg(F.max("x").alias("nx"), F.max("y").alias("ny")).first()
    last, width = size["ny"], size["nx"] + 1
    p = points.filter(F.col("y") >= last - 2).select("x", "y", "lon", (F.col("lon") / precision).cast("long").alias("ilon"))
    order = p.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("ilon", "x")))
    own = order.filter(F.col("y") == last).select("rank", F.col("ilon").alias("own"))
    gap = {r["y"]: r["gap"] for r in order.filter(F.col("y") < last).join(own, "rank").groupBy("y").agg(F.avg(F.abs(F.col("ilon") - F.col("own"))).alias("gap")).collect()}
    row = -2 if gap[last - 1] < gap[last - 2] else -3
    inner = p.filter((F.col("x") >= 1) & (F.col("x") <= width - 2)).withColumn("n", F.row_number().over(Window.partitionBy("y", "ilon").orderBy("x")))
    ref = inner.filter(F.col("y") == last).select("ilon", "n", F.col("x").alias("ref_x"))
    other = inner.filter(F.col("y") == last + 1 + row).select("ilon", "n", F.col("x").alias("match_x"))
    pairs = ref.join(other, ["ilon", "n"])
    if pairs.count() < width - 2:
        raise ValueError("a column of the fold has no partner")
    before = pairs.select((F.col("ref_x") + 1).alias("ref_x"), F.col("match_x").alias("before_x"))  # every inner column has its pair
    step = pairs.join(before, "ref_x", "left").withColumn("diff", F.col("match_x") - F.col("before_x"))
    mean = step.agg(F.avg(F.abs("diff"))).first()[0]
    line = step.filter(F.abs("diff") < 1.5 * mean).agg(F.regr_slope("match_x", "ref_x").alias("a"), F.regr_intercept("match_x", "ref_x").alias("b")).first()
    found = pairs.select("ref_x", F.bround(line["a"] * F.col("ref_x") + line["b"], 0).cast("long").alias("adjacent_x"))
    lon = lambda y, x: p.filter(F.col("y") == y).select(F.col("x").alias(x), F.round("lon", 6).alias(f"lon_{x}"))
    wrong = found.join(lon(last, "ref_x"), "ref_x").join(lon(last + 1 + row, "adjacent_x"), "adjacent_x", "left").filter("lon_ref_x is distinct from lon_adjacent_x")
    if not wrong.isEmpty():
        raise ValueError("the fold's partners have other longitudes")
    return found, row

"""From a model's tables to a prepared mesh in one call: triangles, longitude-latitude grids, curvilinear grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, geometry, remap, topology
from ..sources import models
from ..sources.store import PreparedMesh
from ..sources.tables import cut


def _extent(cells: DataFrame) -> tuple[int, int]:
    size = cells.agg(F.max("ix").alias("nx"), F.max("iy").alias("ny")).first()
    return size["nx"] + 1, size["ny"] + 1


def prepare_triangular(nodes: DataFrame, elements: DataFrame, meshtype: str = "r", cartesian: bool = True, cyclic_length: float = 2 * math.pi, full: bool = False) -> PreparedMesh:
    """``nodes`` (node_id, x, y), ``elements`` (elem_id, nodes[, ocean]), ids from 0.

    ``full`` couples both velocity components through the metric terms; the second component's ids
    are shifted by the number of nodes, which ``filter_velocity`` takes as ``shift``.  Where elements
    are land, nodes without an ocean element keep their values.  Nodes in no element have area 1e-5.
    """
    ge = cut(geometry.triangle_geometry(elements, nodes, meshtype, cartesian, cyclic_length), "geometry")  # read by node areas and operator
    areas = nodes.select("node_id", "x", "y").join(geometry.node_areas(ge), "node_id", "left").fillna(1e-5, ["area"])
    n = nodes.agg(F.max("node_id")).first()[0] + 1 if full else 0
    twice = lambda df: df.unionByName(df.withColumn("node_id", F.col("node_id") + n)) if full else df
    operator = assembly.metric_block(ge, areas, n) if full else assembly.stiffness(ge, areas)
    if "ocean" in elements.columns:
        operator = assembly.masked(operator, twice(remap.mask_to_nodes(elements).filter("ocean").select("node_id")))
    return PreparedMesh(twice(areas), operator, more={"geometry": ge})


def prepare_latlon(cells: DataFrame, cartesian: bool = False, local: bool = True, cyclic_length: float = 2 * math.pi) -> PreparedMesh:
    """``cells`` (cell_id, ix, iy, lon, lat[, ocean]), as ``latlon_grid`` makes them; ``local=False`` wraps in longitude."""
    nb = topology.grid_neighbours(cells, *_extent(cells), "local" if local else "periodic")
    metrics = geometry.latlon_metrics(cells, nb, cartesian, cyclic_length)
    operator = assembly.latlon_operator(nb, metrics, cells if "ocean" in cells.columns else None)
    return PreparedMesh(metrics.select(F.col("cell_id").alias("node_id"), "area"), operator, symmetric=False)


def prepare_curvilinear(cells: DataFrame, fold: DataFrame | None = None, kind: str = "fold", strict: bool = False) -> PreparedMesh:
    """``cells`` as ``nemo_grid`` makes them; ``fold`` (ref_x, adjacent_x) joins the top row to itself, see ``north_fold``."""
    nb = topology.grid_neighbours(cells, *_extent(cells), kind, fold)
    metrics = geometry.nemo_metrics(cells, nb, strict)
    return PreparedMesh(metrics.select(F.col("cell_id").alias("node_id"), "area"), assembly.nemo_operator(nb, metrics, cells), symmetric=False)


def prepare_mesh_mask(mesh: DataFrame, level: int, mask: bool = True, kind: str = "fold", strict: bool = False) -> PreparedMesh:
    """From a mesh-mask table (x, y[, z], glamt, metrics in metres) to the operator of one level in one call.

    With ``fold`` the grid's last row is matched with the one it repeats: the match says how many rows
    and columns are redundant and which cells meet across the fold.  Other kinds trim two rows and columns.
    """
    fold, redundant = None, 2
    if kind == "fold":
        flat = mesh.filter(F.col("z") == level) if "z" in mesh.columns else mesh
        fold, row = topology.north_fold(flat.select("x", "y", F.col("glamt").alias("lon")))
        redundant = -row
    return prepare_curvilinear(models.nemo_grid(mesh, level, redundant, mask), fold, kind, strict)

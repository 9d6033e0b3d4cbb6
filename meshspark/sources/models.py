"""Model meshes as DataFrames: unstructured triangles, regular grids and curvilinear ocean grids.

Canonical tables: nodes (node_id, x, y), elements (elem_id, nodes), grid cells (cell_id, ix, iy, ...).
Files of the classic NetCDF format are read by ``netcdf``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which connectivity is stored, first match wins.
CONNECTIVITY = ("elements", "face_nodes", "elem")


def triangle_mesh(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``lon``, ``lat`` in degrees; elements with 1-based connectivity under one of the known names."""
    name = next((c for c in CONNECTIVITY if c in elements.columns), None)
    if name is None:
        raise RuntimeError(f"no connectivity: one of {', '.join(CONNECTIVITY)} is needed")
    return nodes.select("node_id", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")), elements.select("elem_id", zero_based(F.col(name)).alias("nodes"))


def zero_based(nodes):
    return F.transform(nodes, lambda n: n.cast("long") - 1)


def icon_mesh(nodes: DataFrame, elements: DataFrame, mask: bool = False, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``vlon``, ``vlat`` in radians; cells with 1-based ``vertex_of_cell``.

    ``mask`` reads ``cell_sea_land_mask``: negative is ocean; with ``parity`` every non-zero value is.
    """
    keep = [zero_based(F.col("vertex_of_cell")).alias("nodes")]
    if mask:
        if "cell_sea_land_mask" not in elements.columns:
            raise KeyError("cell_sea_land_mask")
        m = F.col("cell_sea_land_mask")
        keep.append(((m != 0) if parity else (m < 0)).alias("ocean"))
    return nodes.select("node_id", F.degrees("vlon").alias("x"), F.degrees("vlat").alias("y")), elements.select("elem_id", *keep)


def nemo_grid(mesh: DataFrame, level: int, redundant: int = 2, mask: bool = True) -> DataFrame:
    """One level of a curvilinear mesh-mask table (x, y[, z], metrics), trimmed, lengths in km."""
    if "z" not in mesh.columns:
        if level:
            raise ValueError("the mesh has no levels")
        mesh = mesh.withColumn("z", F.lit(0))
    size = mesh.agg(F.max("x").alias("nx"), F.max("y").alias("ny")).first()
    nx, ny = size["nx"] + 1 - redundant, size["ny"] + 1 - redundant
    lengths = [F.col(c) / 1000 for c in ("e1t", "e2t", "e1u", "e2u", "e1v", "e2v")]
    names = ("e1t", "e2t", "e1u", "e2u", "e1v", "e2v")
    ocean = (F.col("tmask") != 0) if mask else F.lit(True)
    return mesh.filter((F.col("z") == level) & (F.col("x") < nx) & (F.col("y") < ny)).select((F.col("x") * ny + F.col("y")).cast("long").alias("cell_id"), F.col("x").alias("ix"), F.col("y").alias("iy"), "glamt", "gphit", *[c.alias(n) for c, n in zip(lengths, names)], (F.col("e3u_0") / 1000).alias("e3u"), (F.col("e3v_0") / 1000).alias("e3v"), (F.col("e3t_0") / 1000).alias("e3t"), ocean.alias("ocean"))


def latlon_grid(longitudes: DataFrame, latitudes: DataFrame) -> DataFrame:
    """Every pair of the coordinate tables (ix, lon) and (iy, lat): the grid itself, lon-major."""
    ny = latitudes.count()
    return longitudes.crossJoin(F.broadcast(latitudes)).select((F.col("ix") * ny + F.col("iy")).cast("long").alias("cell_id"), "ix", "iy", "lon", "lat")


def wrap_region(field: DataFrame, west: float, east: float) -> DataFrame:
    """A longitude window that may cross the date line: eastern longitudes come first, shifted by -360."""
    shifted = field.filter(F.col("lon") >= west + 360).withColumn("lon", F.col("lon") - 360)
    return shifted.unionByName(field.filter((F.col("lon") >= west) & (F.col("lon") <= east)))

"""Geometry of triangles and cells as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scales import RADIUS, cyclic_wrap
from ..sources.tables import large
from .topology import incidence


def triangle_geometry(elements: DataFrame, nodes: DataFrame, meshtype: str = "r", cartesian: bool = True, cyclic_length: float = 2 * math.pi) -> DataFrame:
    """(elem_id, n0..n2, elem_area, dx0..dx2, dy0..dy2, mt[, ocean]).

    ``meshtype`` 'm' takes coordinates as lengths, 'r' as degrees on the sphere.  One join brings the
    coordinates to the corners, one aggregation brings the corners together.
    """
    if meshtype not in ("m", "r"):
        raise ValueError(f"unknown mesh type {meshtype!r}")
    ocean = [F.first("ocean").alias("ocean")] if "ocean" in elements.columns else []
    inc = incidence(elements) if not ocean else elements.select("elem_id", "ocean", F.posexplode("nodes").alias("k", "node_id"))
    corner = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    e = large(inc).join(nodes.select("node_id", "x", "y"), "node_id").groupBy("elem_id").agg(*[corner("node_id", k).alias(f"n{k}") for k in range(3)], *[corner(c, k).alias(f"{c}{k}") for k in range(3) for c in "xy"], *ocean)
    if meshtype == "m":
        x2, x3, y2, y3, mt = F.col("x1") - F.col("x0"), F.col("x2") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("y2") - F.col("y0"), F.lit(1.0)
    else:
        lat = F.radians((F.col("y0") + F.col("y1") + F.col("y2")) / 3)
        c = F.lit(1.0) if cartesian else F.cos(lat)
        x2, x3 = [RADIUS * cyclic_wrap(F.radians(F.col(a) - F.col("x0")), cyclic_length) * c for a in ("x1", "x2")]
        y2, y3 = [RADIUS * F.radians(F.col(a) - F.col("y0")) for a in ("y1", "y2")]
        mt = F.lit(0.0) if cartesian else F.sin(lat) / F.cos(lat) / RADIUS
    e = e.select("*", x2.alias("_x2"), x3.alias("_x3"), y2.alias("_y2"), y3.alias("_y3"), mt.cast("double").alias("mt"))
    e = e.withColumn("_d", F.col("_x2") * F.col("_y3") - F.col("_y2") * F.col("_x3"))
    d = F.when(F.col("_d") != 0, F.col("_d")).otherwise(F.raise_error(F.lit("an element has no area")).cast("double"))
    area = 0.5 * F.abs("_d") * (F.col("ocean").cast("double") if ocean else F.lit(1.0))
    dx = [(F.col("_y2") - F.col("_y3")) / d, F.col("_y3") / d, -F.col("_y2") / d]
    dy = [(F.col("_x3") - F.col("_x2")) / d, -F.col("_x3") / d, F.col("_x2") / d]
    return e.select("elem_id", "n0", "n1", "n2", area.alias("elem_area"), *[c.alias(f"dx{k}") for k, c in enumerate(dx)], *[c.alias(f"dy{k}") for k, c in enumerate(dy)], "mt", *(["ocean"] if ocean else []))


def corners(geometry: DataFrame, *more: str) -> DataFrame:
    """(elem_id, node_id, ...): one row for each corner of the geometry."""
    return geometry.select("elem_id", F.explode(F.array("n0", "n1", "n2")).alias("node_id"), *more)


def node_areas(geometry: DataFrame) -> DataFrame:
    """(node_id, area): a third of the incident elements' area; 1e-5 where that is zero."""
    a = F.sum("elem_area") / 3
    return corners(geometry, "elem_area").groupBy("node_id").agg(a.alias("area")).select("node_id", F.when(F.col("area") == 0, 1e-5).otherwise(F.col("area")).alias("area"))


def latlon_metrics(cells: DataFrame, neighbours: DataFrame, cartesian: bool = False, cyclic_length: float = 2 * math.pi) -> DataFrame:
    """(cell_id, area, hc0..hc3, hh0..hh3) of a grid with lon, lat; where a neighbour is missing the opposite distance stands in."""
    at = cells.select(F.col("cell_id").alias("nbr_id"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"))
    side = lambda c, k: F.max(F.when(F.col("dir") == k, F.col(c)))
    near = neighbours.join(at, "nbr_id").groupBy("cell_id").agg(*[side("nlon", k).alias(f"lon{k}") for k in (0, 2)], *[side("nlat", k).alias(f"lat{k}") for k in range(4)])
    g = cells.select("cell_id", "lon", "lat").join(near, "cell_id", "left")
    lat, lon = F.col("lat"), F.col("lon")
    cm = F.lit(1.0) if cartesian else F.cos(F.radians(sum(F.coalesce(F.col(f"lat{k}"), lat) for k in range(4)) / 4))
    north, south = RADIUS * F.radians(F.col("lat1") - lat), RADIUS * F.radians(lat - F.col("lat3"))
    west = RADIUS * cm * cyclic_wrap(F.radians(lon - F.col("lon0")), cyclic_length)
    east = RADIUS * cm * cyclic_wrap(F.radians(F.col("lon2") - lon), cyclic_length)
    h = g.select("cell_id", F.coalesce(west, east).alias("hc0"), F.coalesce(north, south).alias("hc1"), F.coalesce(east, west).alias("hc2"), F.coalesce(south, north).alias("hc3"))
    ns, we = (F.col("hc1") + F.col("hc3")) / 2, (F.col("hc0") + F.col("hc2")) / 2
    return h.select("cell_id", (ns * we).alias("area"), "hc0", "hc1", "hc2", "hc3", we.alias("hh0"), ns.alias("hh1"), we.alias("hh2"), ns.alias("hh3"))


def nemo_metrics(cells: DataFrame, neighbours: DataFrame, strict: bool = False) -> DataFrame:
    """(cell_id, area, hh0..hh3, hc0..hc3) of a curvilinear grid; two joins in sequence, own values where a neighbour is missing.

    ``strict`` takes the south face's distance from the south neighbour and the east face's from the
    east neighbour; without it the filter's published numbers are met.
    """
    to = lambda k: neighbours.filter(F.col("dir") == k).select("cell_id", F.col("nbr_id").alias(f"q{k}"))
    c = cells.select("cell_id", (F.col("e1t") * F.col("e2t")).alias("area"), F.col("e1v").alias("hh0"), F.col("e2u").alias("hh1"), F.col("e1u").alias("hc0"), F.col("e2v").alias("hc1"))
    for k in (1, 2, 3):
        c = c.join(to(k), "cell_id", "left")
    own = lambda key, *cols: c.select(F.col("cell_id").alias(key), *[F.col(x).alias(f"{x}_{key}") for x in cols])
    c2 = c.join(own("q2", "hh0", "hc0"), "q2", "left").join(own("q3", "hh1", "hc1"), "q3", "left").join(own("q1", "hc1"), "q1", "left")
    c2 = c2.withColumn("hh2", F.coalesce("hh0_q2", "hh0")).withColumn("hh3", F.coalesce("hh1_q3", "hh1"))
    hc3 = F.coalesce("hc1_q3", "hc1") if strict else F.when(F.col("q3").isNotNull(), F.coalesce("hc1_q1", "hc1")).otherwise(F.col("hc1"))
    if strict:
        c2 = c2.withColumn("hc2", F.coalesce("hc0_q2", "hc0"))
    else:
        c2 = c2.join(c2.select(F.col("cell_id").alias("q2"), F.col("hh2").alias("hh2_q2")), "q2", "left").withColumn("hc2", F.when(F.col("q2").isNotNull(), F.col("hh2_q2")).otherwise(F.lit(1.0)))
    return c2.withColumn("hc3", hc3).select("cell_id", "area", "hh0", "hh1", "hh2", "hh3", "hc0", "hc1", "hc2", "hc3")

"""Fields and masks between elements, nodes and cell centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import large
from .geometry import corners


def elements_to_nodes(field: DataFrame, geometry: DataFrame, areas: DataFrame, columns: list[str], ocean: DataFrame | None = None, keys=()) -> DataFrame:
    """(keys, node_id, columns): area-weighted mean of incident elements; 0 on nodes outside ``ocean`` (node_id)."""
    inc = large(corners(geometry, "elem_area")).join(field.select(*keys, "elem_id", *columns), "elem_id")
    sums = large(inc.groupBy(*keys, "node_id").agg(*[F.sum(F.col(c) * F.col("elem_area")).alias(c) for c in columns])).join(areas, "node_id")
    out = sums.select(*keys, "node_id", *[(F.col(c) / 3 / F.col("area")).alias(c) for c in columns])
    if ocean is None:
        return out
    flagged = large(out).join(ocean.select("node_id", F.lit(True).alias("_ocean")), "node_id", "left")
    return flagged.select(*keys, "node_id", *[F.when(F.col("_ocean"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in columns])


def nodes_to_elements(field: DataFrame, geometry: DataFrame, columns: list[str]) -> DataFrame:
    """(elem_id, columns): mean of the three corners; 0 where the element has no area."""
    inc = corners(geometry, "elem_area").join(field.select("node_id", *columns), "node_id")
    return inc.groupBy("elem_id").agg(*[F.when(F.first("elem_area") == 0, F.lit(0.0)).otherwise(F.sum(c) / 3).alias(c) for c in columns])


def mask_to_nodes(elements: DataFrame) -> DataFrame:
    """(node_id, ocean): true if any incident element is ocean."""
    return elements.select(F.explode("nodes").alias("node_id"), "ocean").groupBy("node_id").agg(F.bool_or("ocean").alias("ocean"))


def mask_to_elements(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(elem_id, ocean): true if all three corners are ocean."""
    return elements.select("elem_id", F.explode("nodes").alias("node_id")).join(nodes.select("node_id", "ocean"), "node_id").groupBy("elem_id").agg(F.bool_and("ocean").alias("ocean"))


def faces_to_cells(field: DataFrame, neighbours: DataFrame, mean: bool = False) -> DataFrame:
    """(cell_id, ux, vy) at cell centres: u plus the east face's, v plus the south face's; half of that with ``mean``."""
    to = lambda k, c: neighbours.filter(F.col("dir") == k).select("cell_id", "nbr_id").join(field.select(F.col("cell_id").alias("nbr_id"), F.col(c).alias(f"_{c}")), "nbr_id").drop("nbr_id")
    both = field.join(to(2, "ux"), "cell_id", "left").join(to(3, "vy"), "cell_id", "left")
    w = 0.5 if mean else 1.0
    return both.select("cell_id", *[(w * (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0)))).alias(c) for c in ("ux", "vy")])

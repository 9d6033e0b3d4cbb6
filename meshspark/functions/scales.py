"""Wavenumbers and other scalar functions of fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the radius of the sphere, in km.
RADIUS = 6400.0


def wavenumber(distance: Column) -> Column:
    return 2 * math.pi / distance


def convert_to_wavenumbers(distance: Column, dxm: Column) -> Column:
    """The wavenumber whose filter acts on ``distance`` at mesh resolution ``dxm``; both must be positive."""
    ok = (distance > 0) & (dxm > 0)
    return F.when(ok, 2 * math.pi / (3.5 * distance / dxm)).otherwise(F.raise_error(F.lit("distances must be positive")).cast("double"))


def latitude_scale(lat: Column, slope: float = 300.0, least: float = 150.0) -> Column:
    """A filter scale (km) that grows with the distance from the equator."""
    return slope * F.abs(F.radians(lat)) + least


def log_scales(spark: SparkSession, n: int, first: float, last: float) -> DataFrame:
    """(scale_idx, k): ``n`` distances spaced evenly in the logarithm, as wavenumbers."""
    a, b = math.log10(first), math.log10(last)
    return spark.range(n).select((F.col("id") + 1).cast("int").alias("scale_idx"), (2 * math.pi / F.pow(F.lit(10.0), a + (b - a) * F.col("id") / max(1, n - 1))).alias("k"))


def cyclic_wrap(delta: Column, length: float = 2 * math.pi) -> Column:
    return F.when(delta > length / 2, delta - length).when(delta < -length / 2, delta + length).otherwise(delta)


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def rotate_pole(lon: Column, lat: Column, pole_lat: float) -> tuple[Column, Column]:
    """Longitude and latitude (radians) on a sphere whose pole is tilted to ``pole_lat`` along longitude 0."""
    t = math.pi / 2 - pole_lat
    x, y, z = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    xr, zr = math.cos(t) * x - math.sin(t) * z, math.sin(t) * x + math.cos(t) * z
    return F.atan2(y, xr), F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), zr)))


def register(spark: SparkSession) -> None:
    """The same functions for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wavenumber(distance DOUBLE) RETURNS DOUBLE RETURN 2 * pi() / distance")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION convert_to_wavenumbers(distance DOUBLE, dxm DOUBLE) RETURNS DOUBLE RETURN 2 * pi() / (3.5 * distance / dxm)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cyclic_wrap(delta DOUBLE, len DOUBLE) RETURNS DOUBLE RETURN CASE WHEN delta > len / 2 THEN delta - len WHEN delta < -len / 2 THEN delta + len ELSE delta END")

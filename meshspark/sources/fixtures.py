"""Grids and meshes derived from the relational tables, and small table-free meshes for tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import topology
from .tables import load_table


def li_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 x 10 cells of ``lineitem``: month of shipping by quantity; price and rates as fields."""
    t = load_table(spark, sf_dir, "lineitem")
    ix, iy = (F.month("l_shipdate") - 1).cast("int"), F.floor((F.col("l_quantity") - 1) / 5).cast("int")
    g = t.groupBy(ix.alias("ix"), iy.alias("iy")).agg((F.avg("l_extendedprice") / 1000).alias("value"), (F.avg("l_discount") * 100).alias("ux"), (F.avg("l_tax") * 100).alias("vy"))
    return g.withColumn("node_id", (F.col("ix") * 10 + F.col("iy")).cast("long")).withColumn("snapshot_id", F.lit(0).cast("long"))


def ev_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 x 24 cells of purchases by day and hour; cells without any are land."""
    t = load_table(spark, sf_dir, "events").filter("event_type = 'purchase' and day(ts) <= 30")
    g = t.groupBy((F.dayofmonth("ts") - 1).alias("ix"), F.hour("ts").alias("iy")).agg(F.avg("value").alias("value"))
    g = g.select((F.col("ix") * 24 + F.col("iy")).cast("long").alias("node_id"), "value")
    return spark.range(720).select(F.col("id").alias("node_id")).join(g, "node_id", "left").select(F.lit(0).cast("long").alias("snapshot_id"), "node_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("ocean"))


def emb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-dimensional embedding as an 8 x 8 field."""
    t = load_table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("snapshot_id"), F.posexplode("embedding").alias("j", "v")).select("snapshot_id", F.col("j").cast("long").alias("node_id"), (F.col("j") / 8).cast("int").alias("ix"), (F.col("j") % 8).alias("iy"), F.col("v").cast("double").alias("value"))


COLUMNS = 30  # of the lattices and grids that customers make


@dataclass
class Lattice:
    """``nodes`` (node_id, ix, iy, x, y, lon, lat, nation, ...) of n rows of a table, in columns of ``ny``, and their triangles."""

    nodes: DataFrame
    elements: DataFrame
    nx: int
    ny: int
    n: int


def lattice_of(rows: DataFrame, nx: int, ny: int, n: int) -> Lattice:
    """``rows`` (id, jx, jy, ...): plane and spherical places from the row's place in the lattice and its jitter."""
    ix, iy = F.floor(F.col("id") / ny).cast("int"), (F.col("id") % ny).cast("int")
    at = rows.withColumn("ix", ix).withColumn("iy", iy)
    nodes = at.withColumn("x", F.col("ix") + F.col("jx")).withColumn("y", F.col("iy") + F.col("jy")).withColumn("lon", 2 * F.col("ix") + F.col("jx")).withColumn("lat", 20 + (F.col("iy") + F.col("jy")) * 40.0 / ny)
    nodes = nodes.withColumn("node_id", F.col("id").cast("long")).drop("id", "jx", "jy")
    return Lattice(nodes, topology.lattice_over(nodes, ny, n), nx, ny, n)


def customer_lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    """Every customer is a node: balance and nation move it, and give it masks and values."""
    t = load_table(spark, sf_dir, "customer")
    n = t.count()
    rows = t.select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 11000 * 0.3).alias("jx"), (F.col("c_nationkey") / 25.0 * 0.3).alias("jy"), F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_acctbal") / 1000).alias("value"))
    return lattice_of(rows, COLUMNS, n // COLUMNS, n)


def nation_lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    """The 25 nations on 5 x 5 nodes, with the mean balances of all their customers and suppliers."""
    mean = lambda t, k, c, name: load_table(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.avg(c).alias(name))
    rows = load_table(spark, sf_dir, "nation").join(mean("customer", "c_nationkey", "c_acctbal", "_c"), "n_nationkey", "left").join(mean("supplier", "s_nationkey", "s_acctbal", "_s"), "n_nationkey", "left")
    c, s = F.coalesce("_c", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
    at = rows.select(F.col("n_nationkey").cast("long").alias("id"), ((c + 1000) / 11000 * 0.3).alias("jx"), (F.col("n_regionkey") / 5.0 * 0.3).alias("jy"), F.col("n_nationkey").cast("long").alias("nation"), (c / 1000).alias("ux"), (s / 1000).alias("vy"))
    return lattice_of(at, 5, 5, 25)


def curvilinear_cells(lattice: Lattice) -> DataFrame:
    """The lattice's nodes as cells of a curvilinear grid: metrics from id and nation."""
    m = [(b + F.pmod(mixed_id() * p, F.lit(q)) / q).alias(n) for n, (b, p, q) in NEMO_METRICS.items()]
    return lattice.nodes.select(F.col("node_id").alias("cell_id"), "ix", "iy", *m, (F.col("nation") % 11 != 3).alias("ocean"))


def mixed_id():
    return F.col("node_id") + 31 * F.col("nation")


def level_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh-mask table of two levels over all customers, lengths in metres; the last row mirrors the one before it."""
    t = load_table(spark, sf_dir, "customer")
    half = t.count() // 2
    ny = half // 15
    rows = t.select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("long").alias("nation"))
    m = [(1000 * (b + F.pmod(mixed_id() * p, F.lit(q)) / q)).alias(n if n[:2] != "e3" else f"{n}_0") for n, (b, p, q) in NEMO_METRICS.items()]
    z, at = F.floor(F.col("node_id") / half), F.col("node_id") % half
    x, y = F.floor(at / ny), at % ny
    lon = F.when(y == ny - 2, x * 3.0).when(y == ny - 1, (14 - x) * 3.0).otherwise(x * 3.0 + 0.1 + F.col("nation") / 25.0)
    return rows.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), *m, lon.alias("glamt"), y.cast("double").alias("gphit"), (F.col("nation") % 11 != 3).cast("int").alias("tmask"))


def quantity_longitudes(spark: SparkSession, sf_dir: str, step: float, stretch: float) -> DataFrame:
    """(ix, lon): a longitude for each of the 50 quantities of ``lineitem``, moved by their mean discount."""
    g = load_table(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity") - 1).cast("int").alias("ix")).agg(F.avg("l_discount").alias("d"))
    return g.select("ix", (F.col("ix") * step + F.col("d") * stretch).alias("lon"))


def nation_latitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("iy"), (3.0 * F.col("n_nationkey") - 50 + F.col("n_regionkey") / 10.0).alias("lat"))


def mirrored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as four rows of points whose last mirrors the third from the end; the others lie apart by nation."""
    t = load_table(spark, sf_dir, "customer")
    nx = t.count() // 4
    x, y = F.col("c_custkey") % nx, F.floor(F.col("c_custkey") / nx)
    own = F.when(y == 1, nx - 1 - x).otherwise(x)
    lon = own * 3.0 + F.when(y.isin(1, 3), 0.0).otherwise(0.1 + F.col("c_nationkey") / 25.0)
    return t.select(x.cast("int").alias("x"), y.cast("int").alias("y"), lon.alias("lon")).filter("y < 4")


def jitter(p: int, q: int):
    return F.pmod(F.col("id") * p, F.lit(q)) / q * 0.3


def tri_nodes(spark: SparkSession, n: int = 6) -> DataFrame:
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(n * n).select(F.col("id").alias("node_id"), (i + jitter(7919, 101)).alias("x"), (j + jitter(104729, 97)).alias("y"))


def lattice_nodes(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Jittered nodes of an nx x ny lattice, x-major."""
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    return spark.range(nx * ny).select(F.col("id").alias("node_id"), (i + jitter(7919, 101)).alias("x"), (j + jitter(104729, 97)).alias("y"))


def tri_nodes_sphere(spark: SparkSession, n: int = 6) -> DataFrame:
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(n * n).select(F.col("id").alias("node_id"), (2 * i + jitter(7919, 101)).alias("x"), (20 + 8 * j + jitter(104729, 97)).alias("y"))


#: Base, multiplier and modulus of each metric of the small curvilinear grid.
NEMO_METRICS = {"e1t": (10, 7, 11), "e2t": (12, 5, 13), "e1u": (9, 3, 7), "e2u": (11, 11, 17), "e1v": (10, 13, 19), "e2v": (12, 17, 23), "e3u": (1, 19, 29), "e3v": (1, 23, 31), "e3t": (1, 29, 37)}


def nemo_cells(spark: SparkSession, nx: int = 6, ny: int = 5) -> DataFrame:
    m = [(b + F.pmod(F.col("id") * p, F.lit(q)) / q).alias(n) for n, (b, p, q) in NEMO_METRICS.items()]
    return spark.range(nx * ny).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % ny).cast("int").alias("iy"), *m, (F.col("id") % 11 != 3).alias("ocean"))


def mesh_mask(spark: SparkSession, nx: int = 8, ny: int = 7, levels: int = 2) -> DataFrame:
    """A curvilinear mesh-mask table with levels, lengths in metres."""
    m = [(1000 * (b + F.pmod(F.col("id") * p, F.lit(q)) / q)).alias(n if n[:2] != "e3" else f"{n}_0") for n, (b, p, q) in NEMO_METRICS.items()]
    x, y, z = F.floor(F.col("id") / ny) % nx, F.col("id") % ny, F.floor(F.col("id") / (nx * ny))
    return spark.range(nx * ny * levels).select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), *m, x.cast("double").alias("glamt"), y.cast("double").alias("gphit"), (F.col("id") % 11 != 3).cast("int").alias("tmask"))


def fold_map(spark: SparkSession, nx: int = 6) -> DataFrame:
    return spark.range(nx).select((F.col("id") + 1).alias("ref_x"), (nx - F.col("id")).alias("adjacent_x"))


def fold_points(spark: SparkSession, nx: int = 12) -> DataFrame:
    """Four rows whose last mirrors the third from the end."""
    x, y = F.col("id") % nx, F.floor(F.col("id") / nx)
    own = F.when(y == 1, nx - 1 - x).otherwise(x)
    lon = F.pmod(own * 37, F.lit(nx)) * 10.0 + 5 + F.when(y == 2, 3.3).when(y == 0, 7.1).otherwise(0.0)
    return spark.range(4 * nx).select(x.cast("int").alias("x"), y.cast("int").alias("y"), lon.alias("lon"))

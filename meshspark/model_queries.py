"""Registered queries of the model sources, the entry points and what surrounds the filters."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from . import queries as Q
from .functions import noise, scales
from .operators import geometry, topology
from .plans import filters, prepare
from .queries import CO, EL, GES, K4, LI, NDS, PI2, ST, _EMB, _MEL, _MNODE, INC, dct, grid_sql, jacobi, query, r6, s6
from .sources import fixtures, models, store
from .sources.tables import load_table, shared_folder


def _one_based(elements, name):
    return elements.withColumn(name, F.transform("nodes", lambda n: (n + 1).cast("int"))).drop("nodes")


def _tri_source(spark, sf_dir):
    c = Q.customers(spark, sf_dir)
    return models.triangle_mesh(c.nodes.select("node_id", "lon", "lat"), _one_based(c.elements, "face_nodes"))


@query(f"WITH {Q.SPH}, {ST} SELECT i, j, {s6('s', 's', 9)} FROM st")
def prepare_triangular(spark, sf_dir):
    mesh = prepare.prepare_triangular(*_tri_source(spark, sf_dir), cartesian=False)
    return mesh.operator.select("i", "j", r6(F.col("s"), "s", 9))


_LAND = "gm AS (SELECT ge.* REPLACE (CASE WHEN me.ocean THEN elem_area ELSE 0 END AS elem_area) FROM ge JOIN me USING (elem_id))"


@query(f"WITH {EL}, {NDS}, {GES}, {_MEL}, {_LAND}, {CO.replace('FROM ge', 'FROM gm')}, {Q.AR}, {ST}, {INC}, {_MNODE} SELECT i, j, {s6('s', 's', 9)} FROM st JOIN mn a ON a.node_id = i AND a.ocean JOIN mn b ON b.node_id = j AND b.ocean")
def prepare_radian_mesh_masked(spark, sf_dir):
    """Coordinates in radians, 1-based cells, land from the mask's sign."""
    c = Q.customers(spark, sf_dir)
    nodes = c.nodes.select("node_id", F.radians("lon").alias("vlon"), F.radians("lat").alias("vlat"))
    cells = _one_based(Q.tri_masked(c), "vertex_of_cell").withColumn("cell_sea_land_mask", F.when(F.col("ocean"), -1).otherwise(1)).drop("ocean")
    mesh = prepare.prepare_triangular(*models.icon_mesh(nodes, cells, mask=True), cartesian=False)
    return mesh.operator.select("i", "j", r6(F.col("s"), "s", 9))


_MASKS = ", ".join(f"{b} + ((c_custkey + 31 * c_nationkey) * {p} % {q}) / {q}.0::DOUBLE AS {n}" for n, (b, p, q) in fixtures.NEMO_METRICS.items())
_METRICS = list(fixtures.NEMO_METRICS)


@query(
    f"WITH w AS (SELECT count(*) // 2 AS half, count(*) // 2 // 15 AS ny FROM customer), mm AS (SELECT (c_custkey % half) // ny AS x, (c_custkey % half) % ny AS y, c_custkey // half AS z, ny, {_MASKS}, c_nationkey % 11 <> 3 AS ocean FROM customer, w) "
    f"SELECT r AS redundant, x * (ny - r) + y AS cell_id, {', '.join(s6(n, n) for n in _METRICS)}, ocean FROM mm, (VALUES (2::BIGINT), (3::BIGINT)) v(r) WHERE z = 1 AND x < 15 - r AND y < ny - r"
)
def source_curvilinear_level(spark, sf_dir):
    """One level, two or three redundant rows and columns trimmed, metres to km."""
    one = lambda r: models.nemo_grid(fixtures.level_mask(spark, sf_dir), 1, r).select(F.lit(r).cast("long").alias("redundant"), "cell_id", *[r6(F.col(n), n) for n in _METRICS], "ocean")
    return one(2).unionByName(one(3))


_WRAP = "CASE WHEN {d} > pi() THEN {d} - 2 * pi() WHEN {d} < -pi() THEN {d} + 2 * pi() ELSE {d} END"
_PLM = (
    f"{grid_sql(50, 25, 'periodic')}, {Q.latlon_sql(7.2, 10.0)}, ln AS (SELECT cell_id, "
    + ", ".join(f"max(CASE WHEN dir = {k} THEN l.lon END) AS lon{k}, max(CASE WHEN dir = {k} THEN l.lat END) AS lat{k}" for k in range(4))
    + " FROM nb JOIN (SELECT cell_id AS nbr_id, lon, lat FROM lc) l USING (nbr_id) GROUP BY 1), "
    f"lh AS (SELECT cell_id, coalesce(n, s) AS hc1, coalesce(s, n) AS hc3, 6400 * cm * {_WRAP.format(d='w')} AS hc0, 6400 * cm * {_WRAP.format(d='e')} AS hc2 FROM (SELECT cell_id, 6400 * radians(lat1 - lat) AS n, 6400 * radians(lat - lat3) AS s, radians(lon - lon0) AS w, radians(lon2 - lon) AS e, cos(radians((2 * lat + coalesce(lat1, lat) + coalesce(lat3, lat)) / 4)) AS cm FROM lc JOIN ln USING (cell_id))), "
    "lm AS (SELECT cell_id, hc0, hc1, hc2, hc3, (hc1 + hc3) / 2 AS ns, (hc0 + hc2) / 2 AS we FROM lh), "
    "off AS (SELECT cell_id AS i, nbr_id AS j, CASE dir WHEN 0 THEN hc0 / we WHEN 1 THEN hc1 / ns WHEN 2 THEN hc2 / we ELSE hc3 / ns END / (ns * we) AS s FROM nb JOIN lm USING (cell_id) WHERE nbr_id % 7 <> 3)"
)


@query(f"WITH {_PLM} SELECT i, j, {s6('sum(s)', 's', 9)} FROM ({Q._CLOSE}) WHERE i % 7 <> 3 AND j % 7 <> 3 GROUP BY 1, 2")
def prepare_latlon_masked_periodic(spark, sf_dir):
    """All the way round the sphere, so that differences unwrap, with land."""
    cells = Q._latlon_cells(spark, sf_dir, 7.2, 10.0).withColumn("ocean", F.col("cell_id") % 7 != 3)
    return prepare.prepare_latlon(cells, local=False).operator.select("i", "j", r6(F.col("s"), "s", 9))


# longitudes and coordinates


@query("SELECT c_custkey, lon - 360.0 AS lon FROM (SELECT c_custkey, (c_custkey * 7 % 360)::DOUBLE AS lon FROM customer) WHERE lon >= 260 UNION ALL SELECT c_custkey, (c_custkey * 7 % 360)::DOUBLE FROM customer WHERE c_custkey * 7 % 360 <= 90")
def region_wrap(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 360).cast("double").alias("lon"))
    return models.wrap_region(c, -100, 90)


_ANGLE = "radians(c_custkey * 37 % 720 - 360.0::DOUBLE)"


@query(f"SELECT c_custkey, {s6(_WRAP.format(d=_ANGLE), 'delta')} FROM customer")
def cyclic_differences(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    return c.select("c_custkey", r6(scales.cyclic_wrap(F.radians(F.col("c_custkey") * 37 % 720 - 360.0)), "delta"))


_POLE = math.radians(60)
_LON, _LAT = "radians(c_custkey * 37 % 360 - 179.5::DOUBLE)", "radians(c_custkey * 13 % 179 - 89.0::DOUBLE)"
_TILT = math.pi / 2 - _POLE


@query(
    f"SELECT c_custkey, {s6('atan2(y, cos(t) * x - sin(t) * z)', 'lon')}, {s6('asin(least(1.0, greatest(-1.0, sin(t) * x + cos(t) * z)))', 'lat')} "
    f"FROM (SELECT c_custkey, {_TILT}::DOUBLE AS t, cos({_LAT}) * cos({_LON}) AS x, cos({_LAT}) * sin({_LON}) AS y, sin({_LAT}) AS z FROM customer)"
)
def rotated_pole(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    lon, lat = scales.rotate_pole(F.radians(F.col("c_custkey") * 37 % 360 - 179.5), F.radians(F.col("c_custkey") * 13 % 179 - 89.0), _POLE)
    return c.select("c_custkey", r6(lon, "lon"), r6(lat, "lat"))


def _over_date_line(lattice):
    """The spherical lattice, moved so that it lies on both sides of the date line."""
    return Q.sphere(lattice).withColumn("x", F.pmod(F.col("x") + 175 + 180, F.lit(360.0)) - 180)


@query(f"WITH {Q.SPH} SELECT elem_id, {s6('elem_area', 'elem_area', 4)}, {', '.join(s6(c, c, 9) for c in ('dx0', 'dx1', 'dx2', 'dy0', 'dy1', 'dy2', 'mt'))} FROM ge")
def tri_geometry_dateline(spark, sf_dir):
    """Geometry does not see the date line: the check is the same mesh elsewhere."""
    c = Q.customers(spark, sf_dir)
    ge = geometry.triangle_geometry(c.elements, _over_date_line(c), "r", cartesian=False)
    return ge.select("elem_id", r6(F.col("elem_area"), "elem_area", 4), *[r6(F.col(c), c, 9) for c in ("dx0", "dx1", "dx2", "dy0", "dy1", "dy2", "mt")])


@query(f"WITH {EL}, {NDS}, {INC}, sh AS (SELECT node_id, CASE WHEN x + 175 >= 180 THEN x + 175 - 360 ELSE x + 175 END AS x FROM nd) SELECT elem_id FROM inc JOIN sh USING (node_id) GROUP BY 1 HAVING max(x) - min(x) < 10")
def date_line_elements(spark, sf_dir):
    c = Q.customers(spark, sf_dir)
    return topology.date_line_free(c.elements, _over_date_line(c)).select("elem_id")


@query(f"WITH w AS (SELECT log10(100.0::DOUBLE * min(p_size)) AS a, log10(100.0::DOUBLE * max(p_size)) AS b FROM part) SELECT (i + 1)::BIGINT AS scale_idx, {s6('2 * pi() / pow(10.0, a + (b - a) * i / 19)', 'k', 9)} FROM w, range(20) t(i)")
def scales_log(spark, sf_dir):
    """Twenty scales between the smallest and the largest part."""
    w = load_table(spark, sf_dir, "part").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b")).first()
    return scales.log_scales(spark, 20, 100 * w["a"], 100 * w["b"]).select(F.col("scale_idx").cast("long").alias("scale_idx"), r6(F.col("k"), "k", 9))


_FREQ = "CASE WHEN {m} > 4 THEN {m} - 8 ELSE {m} END"
_KER = (
    f"fq AS (SELECT p, r, {_FREQ.format(m='p')} AS fp, {_FREQ.format(m='r')} AS fr FROM range(8) a(p), range(8) b(r) WHERE p + r > 0), "
    "ke AS (SELECT dx, dy, sum(cos(2 * pi() * (p * dx + r * dy) / 8) / pow(sqrt((fp * fp + fr * fr)::DOUBLE), 1.5)) / 64 AS h FROM fq, range(8) c(dx), range(8) d(dy) GROUP BY 1, 2)"
)


@query(f"WITH {_EMB}, {_KER} SELECT vec_id, (x * 8 + y)::BIGINT AS node_id, {s6('sum(value * h)', 'value')} FROM em, range(8) a(x), range(8) b(y), ke WHERE dx = (x - ix + 8) % 8 AND dy = (y - iy + 8) % 8 GROUP BY 1, 2")
def red_noise(spark, sf_dir):
    """Every embedding, read as white noise on 8 x 8 cells, with a red spectrum; the check is a convolution."""
    red = load_table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", noise.red_noise(F.col("embedding").cast("array<double>"), 8, 8).alias("v"))
    return red.select("vec_id", F.posexplode("v").alias("node_id", "value")).select("vec_id", F.col("node_id").cast("long").alias("node_id"), r6(F.col("value"), "value"))


# filters and spectra


@query(
    "WITH ev AS (SELECT day(ts) - 1 AS ix, hour(ts) AS iy, avg(value) AS value FROM events WHERE event_type = 'purchase' AND day(ts) <= 30 GROUP BY 1, 2), "
    f"fl AS (SELECT c // 24 AS ix, c % 24 AS iy, coalesce(value, 0) AS value, value IS NOT NULL AS ocean FROM range(720) t(c) LEFT JOIN ev ON ix = c // 24 AND iy = c % 24), {dct(30, 24, PI2 / 3, 1, 'fl', ['value'])} "
    f"SELECT (ix * 24 + iy)::BIGINT AS node_id, {s6('CASE WHEN ocean THEN o.value END', 'filtered')} FROM fl JOIN out o USING (ix, iy)"
)
def filter_filled(spark, sf_dir):
    """Land takes a neutral value, and is masked again afterwards."""
    return filters.filter_with_fill(Q.uniform(spark, 30, 24), fixtures.ev_grid(spark, sf_dir), PI2 / 3).select("node_id", r6(F.col("filtered"), "filtered"))


@query(f"WITH {LI}, {dct(12, 10, K4, 2, 'li', ['value'])} SELECT (ix * 10 + iy)::BIGINT AS node_id, {s6('value', 'filtered')} FROM out")
def filter_spectral_tier(spark, sf_dir):
    f = fixtures.li_grid(spark, sf_dir)
    return filters.filter_field(Q.uniform(spark, 12, 10), f, K4, order=2, solver="spectral").select("node_id", r6(F.col("filtered"), "filtered"))


# a triangular mesh that holds all of li_grid

_JX, _JY = "(id * 7919 % 101) / 101.0 * 0.3", "(id * 104729 % 97) / 97.0 * 0.3"
_BIG = (
    "el AS (SELECT 2 * (n * 9 + q) + h AS elem_id, CASE WHEN h = 0 THEN n * 10 + q ELSE n * 10 + q + 1 END AS n0, CASE WHEN h = 0 THEN n * 10 + q + 1 ELSE (n + 1) * 10 + q + 1 END AS n1, (n + 1) * 10 + q AS n2 FROM range(11) a(n), range(9) b(q), range(2) c(h)), "
    f"nd AS (SELECT id AS node_id, (id // 10) + {_JX} AS x, (id % 10) + {_JY} AS y FROM range(120) t(id)), {Q.GE}, {CO}, {Q.AR}, {ST}, op AS (SELECT * FROM st), {LI}, tf AS (SELECT ix * 10 + iy AS node_id, value FROM li), phi AS (SELECT node_id AS i, value AS v FROM tf)"
)
_K8 = PI2 / 8


def big_mesh(spark):
    return prepare.prepare_triangular(fixtures.lattice_nodes(spark, 12, 10), topology.lattice(spark, 12, 10), "m")


@query(f"WITH RECURSIVE {_BIG}, dk AS (SELECT i, {1 / K4**2} AS d FROM range(120) t(i)), {jacobi(500, 0.7)} SELECT i AS node_id, {s6('z', 'filtered')} FROM sol")
def filter_tri_whole(spark, sf_dir):
    return filters.filter_field(big_mesh(spark), fixtures.li_grid(spark, sf_dir), K4).select("node_id", r6(F.col("filtered"), "filtered"))


@query(
    f"WITH RECURSIVE {_BIG}, dk AS (SELECT i, {1 / _K8**2} AS d FROM range(120) t(i)), {jacobi(800, 0.7)} "
    f"SELECT 0::BIGINT AS scale_idx, {s6('sum(area * value * value) / sum(area)', 'energy')} FROM tf JOIN ar USING (node_id) UNION ALL "
    f"SELECT 1, {s6('sum(area * (z - value) * (z - value)) / sum(area)', 'energy')} FROM tf JOIN ar USING (node_id) JOIN sol ON i = node_id"
)
def spectra_unequal_areas(spark, sf_dir):
    one = spark.createDataFrame([(1, _K8)], "scale_idx int, k double")
    return filters.spectra(big_mesh(spark), fixtures.li_grid(spark, sf_dir), one).select(F.col("scale_idx").cast("long").alias("scale_idx"), r6(F.col("energy"), "energy"))


@query(Q.ORACLES["spectra_scalar"])
def spectra_sink(spark, sf_dir):
    """Spectra written by snapshot and read back."""
    path = f"{shared_folder(spark)}/spectra-{uuid.uuid4().hex}"
    store.save_spectra(Q._spectrum(spark, sf_dir), path)
    return Q._sp(spark.read.parquet(path))



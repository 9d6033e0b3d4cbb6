"""Filters and spectra over many fields at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import PreparedMesh
from .solver import solve


def _scaled(fields: DataFrame, k) -> DataFrame:
    """``k``: a number, or (node_id, k)."""
    if isinstance(k, DataFrame):
        return fields.join(k.select("node_id", "k"), "node_id")
    return fields.withColumn("k", F.lit(float(k)))


def filter_field(mesh: PreparedMesh, fields: DataFrame, k, order: int = 1, keys=("snapshot_id",), solver: str = "auto") -> DataFrame:
    """(keys, node_id, value, filtered): low-pass of every field."""
    f = _scaled(fields.select(*keys, "node_id", "value"), k)
    return solve(mesh, f.select(*keys, "node_id", "value", "k"), list(keys), order, solver).drop("k")


def highpass(filtered: DataFrame) -> DataFrame:
    return filtered.withColumn("highpass", F.col("value") - F.col("filtered"))


def filter_velocity(mesh: PreparedMesh, fields: DataFrame, k, order: int = 1, keys=("snapshot_id",), shift: int | None = None, solver: str = "auto") -> DataFrame:
    """(keys, node_id, ux, vy) low-passed: two right-hand sides in one batch, or with ``shift`` one coupled system.

    ``shift`` is the number added to node ids for the second component in a metric block operator.
    """
    parts = F.array(F.struct(F.lit(0).alias("comp"), F.col("ux").alias("value")), F.struct(F.lit(1).alias("comp"), F.col("vy").alias("value")))
    long = _scaled(fields.select(*keys, "node_id", F.explode(parts).alias("p")).select(*keys, "node_id", "p.comp", "p.value"), k)
    if shift is None:
        done = solve(mesh, long.select(*keys, "comp", "node_id", "value", "k"), [*keys, "comp"], order, solver)
    else:
        both = long.withColumn("node_id", F.col("node_id") + F.col("comp") * shift)
        done = solve(mesh, both.select(*keys, "node_id", "value", "k"), list(keys), order, solver)
        done = done.withColumn("comp", F.when(F.col("node_id") >= shift, 1).otherwise(0)).withColumn("node_id", F.col("node_id") - F.col("comp") * shift)
    of = lambda c: F.max(F.when(F.col("comp") == c, F.col("filtered")))
    return done.groupBy(*keys, "node_id").agg(of(0).alias("ux"), of(1).alias("vy"))


def filter_with_fill(mesh: PreparedMesh, fields: DataFrame, k, neutral: float = 0.0, order: int = 1, keys=("snapshot_id",)) -> DataFrame:
    """Masked filtering by filling: ``fields`` has ``ocean``; land takes a neutral value and is masked again afterwards."""
    filled = fields.withColumn("value", F.when(F.col("ocean"), F.col("value")).otherwise(F.lit(neutral)))
    done = filter_field(mesh, filled, k, order, keys)
    return done.join(fields.select(*keys, "node_id", "ocean"), [*keys, "node_id"]).withColumn("filtered", F.when(F.col("ocean"), F.col("filtered")))


def spectra(mesh: PreparedMesh, fields: DataFrame, scales: DataFrame, order: int = 1, columns=("value",), excluded: DataFrame | None = None, solver: str = "auto", shift: int | None = None) -> DataFrame:
    """(snapshot_id, scale_idx, k, energy): row 0 is the whole field's, then what each scale's high-pass holds.

    ``scales`` is (scale_idx, k) or (scale_idx, node_id, k).  Fields, components and scales are one
    batch of right-hand sides and one aggregation.  ``excluded`` (node_id) leaves nodes out of the sums.
    With ``shift`` two columns are the components of one coupled system, whose second component has the
    number added to its node ids, as in ``filter_velocity``; each scale of a snapshot is then one right-hand side.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("comp"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    long = fields.select("snapshot_id", "node_id", F.explode(parts).alias("p")).select("snapshot_id", "node_id", "p.comp", "p.value")
    # a handful of scales; each right-hand side is one row set of the batch
    batch = long.join(scales, "node_id") if "node_id" in scales.columns else long.join(F.broadcast(scales.withColumn("_j", F.lit(1))), F.lit(1) == F.col("_j")).drop("_j")
    if shift is None:
        keys = ["snapshot_id", "scale_idx", "comp"]
        done = solve(mesh, batch.select(*keys, "node_id", "value", "k"), keys, order, solver)
    else:
        keys = ["snapshot_id", "scale_idx"]
        both = batch.withColumn("node_id", F.col("node_id") + F.col("comp") * shift)
        done = solve(mesh, both.select(*keys, "node_id", "value", "k"), keys, order, solver).withColumn("node_id", F.col("node_id") % shift)
    whole = long.select("snapshot_id", F.lit(0).alias("scale_idx"), "node_id", F.col("value").alias("e"), F.lit(None).cast("double").alias("k"))
    parts_ = done.select("snapshot_id", "scale_idx", "node_id", (F.col("filtered") - F.col("value")).alias("e"), "k")
    rows = whole.unionByName(parts_).join(mesh.node.select("node_id", "area"), "node_id")
    if excluded is not None:
        rows = rows.join(excluded.select("node_id"), "node_id", "left_anti")
    n = len(columns)
    k = F.first("k").alias("k") if "node_id" not in scales.columns else F.lit(None).cast("double").alias("k")
    return rows.groupBy("snapshot_id", "scale_idx").agg(k, (F.sum(F.col("area") * F.col("e") * F.col("e")) / F.sum("area") * n).alias("energy"))


def _steps(spectrum: DataFrame) -> DataFrame:
    """Differences between successive scales; wavenumber 0's place is taken by the first scale's."""
    by = Window.partitionBy("snapshot_id").orderBy("scale_idx")
    r = F.when(F.col("scale_idx") == 0, 0.0).otherwise(2 * 3.141592653589793 / F.col("k"))
    s = spectrum.withColumn("k", F.coalesce("k", F.lead("k").over(by))).withColumn("r", r)
    lagged = s.withColumn("_k", F.lag("k").over(by)).withColumn("_r", F.lag("r").over(by)).withColumn("de", F.col("energy") - F.lag("energy").over(by))
    return lagged.withColumn("dk", F.col("k") - F.col("_k")).withColumn("dr", F.col("r") - F.col("_r")).withColumn("k_mid", F.sqrt(F.col("k") * F.col("_k"))).withColumn("r_mid", F.sqrt(F.col("r") * F.col("_r"))).filter("scale_idx > 1")


def wavelength_spectrum(spectrum: DataFrame) -> DataFrame:
    return _steps(spectrum).select("snapshot_id", "scale_idx", "k_mid", (-F.col("de") / F.col("dk")).alias("density"))


def epsilon_spectrum(spectrum: DataFrame) -> DataFrame:
    return _steps(spectrum).select("snapshot_id", "scale_idx", "r_mid", (F.col("de") / F.col("dr")).alias("density"))


def mean_energy_spectrum(spectrum: DataFrame) -> DataFrame:
    return _steps(spectrum).select("snapshot_id", "scale_idx", "r_mid", (F.col("r_mid") * F.col("r_mid") * F.col("de") / F.col("dr")).alias("density"))


def radial_spectrum(modes: DataFrame) -> DataFrame:
    """(bin, energy) from (kx, ky, energy): summed in rings of unit width."""
    return modes.groupBy(F.floor(F.hypot("kx", "ky")).alias("bin")).agg(F.sum("energy").alias("energy"))

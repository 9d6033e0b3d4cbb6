"""Spectra of many snapshots, wave after wave, so that a run that was stopped goes on where it was."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import remap
from ..sources.store import PreparedMesh, save_spectra
from .filters import spectra


def finished(fields: DataFrame, path: str) -> DataFrame | None:
    """(snapshot_id) of the spectra that lie under ``path``, or None where there are none yet."""
    try:
        return fields.sparkSession.read.parquet(path).select(F.col("snapshot_id").cast(fields.schema["snapshot_id"].dataType)).distinct()
    except AnalysisException:
        return None


def batch_spectra(mesh: PreparedMesh, geometry: DataFrame, fields: DataFrame, scales: DataFrame, path: str, columns=("ux", "vy"), order: int = 1, waves: int = 1, shift: int | None = None, ocean: DataFrame | None = None, solver: str = "auto") -> int:
    """Fields (snapshot_id, elem_id, columns) from elements to nodes, their spectra, a folder of results for each snapshot.

    Snapshots that have their results are left out by an anti-join.  The others are dealt by a hash into
    ``waves``, each one job that Spark spreads over snapshots, scales and components and commits whole; a
    stopped run loses the wave it was in.  Returns the number of waves that had work.
    """
    done = finished(fields, path)
    todo = fields if done is None else fields.join(done, "snapshot_id", "left_anti")
    wave, ran = F.pmod(F.xxhash64("snapshot_id"), F.lit(waves)), 0
    areas = mesh.node.select("node_id", "area")
    for w in range(waves):
        part = todo.filter(wave == w)
        if part.isEmpty():
            continue
        nodes = remap.elements_to_nodes(part, geometry, areas, list(columns), ocean, keys=("snapshot_id",))
        save_spectra(spectra(mesh, nodes, scales, order, columns, solver=solver, shift=shift), path)
        ran += 1
    return ran

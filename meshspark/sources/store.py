"""Prepared meshes on disk: one Parquet table for each part, written once and solved many times."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .tables import cut


@dataclass
class PreparedMesh:
    """What a filter needs: ``node`` (node_id, area[, x, y]) and ``operator`` (i, j, s), positive sign; other tables as they come.

    ``grid`` is (nx, ny, cell area) of a closed uniform grid with ids ix * ny + iy, which cosine transforms can solve.
    """

    node: DataFrame
    operator: DataFrame
    symmetric: bool = True
    more: dict[str, DataFrame] = field(default_factory=dict)
    grid: tuple[int, int, float] | None = None
    cache: dict = field(default_factory=dict, repr=False, compare=False)  # what solves make once, never saved

    def write(self) -> None:
        """From now on ``node`` and ``operator`` are read from tables, not assembled anew by each job."""
        if not self.cache.get("written"):
            self.node, self.operator = cut(self.node, "mesh-node"), cut(self.operator, "mesh-operator")
            self.cache["written"] = True


NEEDED = {"node": {"node_id": "bigint", "area": "double"}, "operator": {"i": "bigint", "j": "bigint", "s": "double"}}


def checked(df: DataFrame, name: str) -> DataFrame:
    kinds = dict(df.dtypes)
    for c, kind in NEEDED.get(name, {}).items():
        if kinds.get(c) != kind:
            raise ValueError(f"{name}.{c} must be {kind}, not {kinds.get(c)}")
    return df


def coerced(df: DataFrame, name: str) -> DataFrame:
    """Columns of other numeric types, as older files may hold, as the types needed; a column that is missing raises."""
    for c, kind in NEEDED.get(name, {}).items():
        if c in df.columns:
            df = df.withColumn(c, df[c].cast(kind))
    return checked(df, name)


def save(mesh: PreparedMesh, path: str) -> None:
    spark = mesh.node.sparkSession
    for name, df in {"node": mesh.node, "operator": mesh.operator, **mesh.more}.items():
        checked(df, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(mesh.symmetric, sorted(mesh.more), *(mesh.grid or (None, None, None)))], "symmetric boolean, more array<string>, nx int, ny int, cell_area double").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> PreparedMesh:
    """A saved mesh; what an older file lacks is filled: no further tables, no grid, and no symmetry taken for granted."""
    meta = {"symmetric": False, "more": [], "nx": None} | spark.read.parquet(f"{path}/meta").first().asDict()
    read = lambda n: coerced(spark.read.parquet(f"{path}/{n}"), n)
    grid = (meta["nx"], meta["ny"], meta["cell_area"]) if meta["nx"] else None
    return PreparedMesh(read("node"), read("operator"), bool(meta["symmetric"]), {n: read(n) for n in meta["more"] or []}, grid, {"written": True})


def save_spectra(spectra: DataFrame, path: str) -> None:
    """One folder for each snapshot; those of other snapshots stay."""
    spectra.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)

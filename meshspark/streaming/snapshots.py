"""Filtering fields as they arrive: each micro-batch of whole snapshots is solved by an operator made once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.filters import filter_field
from ..sources.store import PreparedMesh


def filter_stream(mesh: PreparedMesh, fields: DataFrame, k: float, path: str, checkpoint: str, order: int = 1, solver: str = "auto") -> StreamingQuery:
    """``fields`` streams (snapshot_id, values ARRAY<DOUBLE>), a whole field in each row in node order; results go to Parquet by snapshot.

    A batch that is run again overwrites its own folder, so results appear once.  The operator is
    assembled and broadcast, or dealt into blocks, before the first batch and kept with the mesh.
    """
    from pyspark.sql import functions as F

    def write(batch: DataFrame, batch_id: int) -> None:
        long = batch.select("snapshot_id", F.posexplode("values").alias("node_id", "value")).withColumn("node_id", F.col("node_id").cast("long"))
        filter_field(mesh, long, k, order, solver=solver).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return fields.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""What the operators share: written tables that cut lineage, hashing and streaming over sorted blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the JVM's regular expressions: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a single machine has its own where that is unset (tests), a cluster raises."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


#: Rows of the Arrow batches between the JVM and Python while a table is written.
BATCH_ROWS = 2000


def written(df: DataFrame, name: str, codec: str = "snappy", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files that survive lost executors.

    Arrow batches are kept small meanwhile: they hold whole texts, in the JVM and in Python.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, str(batch_rows))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(key, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``groups``, a table of one row for each key that counts the key's rows in ``n``.

    Keys with over a 2000th of all counted rows (so at most 2000 keys) go to their rows by broadcast;
    the rows of all other keys meet theirs in a shuffle, where no key can fill a task.
    """
    total, most = groups.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(256, total // 2000)
    if most <= limit:
        return rows.join(groups, keys)
    hot = groups.filter(F.col(n) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(groups.filter(F.col(n) <= limit), keys))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def with_running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str, codec: str = "snappy") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the same group, and the row itself, in ``order``.

    A distributed prefix sum.  Rows are range-partitioned by (group, order) and written; each
    partition's totals (at most partitions + groups rows) are summed into offsets and broadcast; the
    running sum inside one (partition, group) never holds more than one range partition, so a group
    with a third of all rows is spread over a third of the tasks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = written(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), name, codec)
    from pyspark.sql import Window

    sums = staged.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    cond = F.col("_part") == F.col("_p")
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the offsets have at most (range partitions + groups) rows, whatever the input's size
    return (
        staged.withColumn("_local", F.sum(value).over(local))
        .join(F.broadcast(offsets), cond)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_part", "_p", "_before", "_local", *[f"_g_{c}" for c in group])
    )


def blocks(batches, key: str):
    """From Arrow batches sorted by ``key``: one Arrow table for each run of equal keys."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = t.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = t.slice(a, b - a)
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)

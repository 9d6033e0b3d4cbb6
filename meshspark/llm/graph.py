"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


#: Edges that one task contracts.
STRETCH = 200_000


def contracted(edges: DataFrame, most: int = STRETCH) -> DataFrame:
    """(u, v), u > v: the same components with fewer edges, from union-find over stretches of at most ``most`` edges of a partition."""

    def work(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        def stars():
            rows = [(x, root(x)) for x in list(up)]
            up.clear()
            rows = [r for r in rows if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

        n = 0
        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = root(a), root(c)
                up[max(a, c)] = min(a, c)
            n += b.num_rows
            if n >= most:
                yield stars()
                n = 0
        yield stars()

    return edges.select("a", "b").filter("a <> b").mapInArrow(work, "u long, v long")


def _least(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(u, v) with ``m``, the least v of each u; nodes in ``hot`` (u, m) get theirs by broadcast, so none fills a task."""
    cold = rows if hot is None else rows.join(F.broadcast(hot), "u", "left_anti")
    out = cold.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return out if hot is None else out.unionByName(rows.join(F.broadcast(hot), "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id with an edge other than the root itself; ``edges`` has long columns a and b.

    Stretches of edges are contracted in their tasks first, twice: as they come, and what that leaves.
    Every round moves neighbours to the smallest id seen; edges stay a table of the shared folder and
    are never collected.  Nodes with over a 2000th of all edge ends (so at most 2000) are treated
    apart: their minima are pre-aggregated and broadcast.
    """
    spark = edges.sparkSession
    # written first: Python on top of Python in one stage would hold two workers a task
    e = written(contracted(written(edges.select("a", "b"), "edges")), "edges")
    # what is left meets in as many tasks as it fills, so that few edges need few rounds
    tasks = max(1, -(-e.count() // STRETCH))
    e = written(contracted(e.toDF("a", "b").coalesce(tasks)), "edges")
    for _ in range(rounds):
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("up")), F.struct(F.col("v").alias("x"), F.lit(None).cast("long").alias("up")))).alias("s"))
        nodes = ends.groupBy("s.x").agg(F.count(F.lit(1)).alias("n"), F.count("s.up").alias("ups"), F.min("s.up").alias("lo"), F.max("s.up").alias("hi"))
        # settled: every node has one edge, to one that has none
        total, most, loose = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if((F.col("lo") != F.col("hi")) | (F.col("ups") > 0) & (F.col("ups") < F.col("n")))).first()
        if not loose:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).distinct()
        limit, hot = max(256, total // 2000), None
        if most > limit:
            hot = spark.createDataFrame(nodes.filter(F.col("n") > limit).select("x", F.coalesce("lo", "x")).collect(), "u long, m long")  # at most 2000
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, hot).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        if hot is not None:
            large = written(large, "edges")
            hot = large.join(F.broadcast(hot.select("u")), "u", "left_semi").groupBy("u").agg(F.min("v").alias("m"))
        small = _least(large, hot)
        e = written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")

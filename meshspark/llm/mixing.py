"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies.  Ordered by size within the
source, the expected copies are prefix-summed (in whole units of 2^-24, so sums are exact whatever
their order), one offset drawn from the seed and the source is added, and a document is emitted once
for each integer that its interval crosses.  Ordering by size keeps the words taken close to the
target.  Reruns agree.

Null or wordless texts have size 0 and still expect copies; a source whose size is 0 gets none.  A
null source is a source of its own, ordered last.  Rows equal in id, source and text are
interchangeable.  Very long texts count whole.  An empty table gives an empty result.  Columns of the
documents keep their names; those that begin with ``_mix_`` are reserved and raise as ambiguous.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, with_running_sum, written

UNIT = 1 << 24


def targets(sizes: dict, weights=(5, 2, 1), cap: int = 3) -> dict:
    """Target of each source: weights repeat over sources by code point, null last; above ``cap`` times the size the excess is reshared."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, left = {}, set(names), float(sum(sizes.values()))
    while rest:
        level = left / sum(w[s] for s in rest)
        over = {s for s in rest if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in rest}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        rest -= over
    return out


def text_key(text_col: str):
    """128 bits that stand for a text; of no bits for null."""
    return F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit("").cast("binary"))


def mix_copies(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix", id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(id, source, text_key, size, source_size, target, copies), one row for each document."""
    spark = docs.sparkSession
    sized = written(docs.select(id_col, F.col(source_col).alias("source"), F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("size"), text_key(text_col).alias("text_key")), "mix-sizes")
    # one row for each source, by its nature a short list of names
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    size_of = {r["source"]: r["n"] for r in rows}
    goal = targets(size_of, weights, cap)
    plan = spark.createDataFrame([(s, n, goal[s], round(goal[s] / n * UNIT) if n else 0) for s, n in size_of.items()], "plan_source string, source_size long, target double, units long")
    planned = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    summed = with_running_sum(planned, ["source"], ["size", id_col, "text_key"], "units", "_to", "mix-order")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\0"))).cast("binary")), 1, 6), 16, 10).cast("long")
    crossed = lambda c: F.shiftright(c + offset, 24)
    return summed.withColumn("copies", (crossed(F.col("_to")) - crossed(F.col("_to") - F.col("units"))).cast("long")).drop("_to", "units")


def mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **how) -> DataFrame:
    """The documents themselves, each as many times as it was drawn."""
    k = "_mix_"
    drawn = mix_copies(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how).groupBy(id_col, "source", "text_key").agg(F.sum("copies").alias(f"{k}copies"), F.count(F.lit(1)).alias(f"{k}rows")).filter(F.col(f"{k}copies") > 0)
    drawn = written(drawn.select(F.col(id_col).alias(f"{k}id"), F.col("source").alias(f"{k}source"), F.col("text_key").alias(f"{k}key"), f"{k}copies", f"{k}rows"), "mix-drawn")
    own = docs.withColumn(f"{k}own", text_key(text_col))
    if not drawn.filter(F.col(f"{k}rows") > 1).isEmpty():  # rows equal in id, source and text: one row stands for all
        own = own.dropDuplicates([id_col, source_col, f"{k}own"])
    hit = own.join(drawn, own[id_col].eqNullSafe(F.col(f"{k}id")) & own[source_col].eqNullSafe(F.col(f"{k}source")) & (F.col(f"{k}own") == F.col(f"{k}key")))
    return hit.withColumn(f"{k}n", F.explode(F.sequence(F.lit(1), F.col(f"{k}copies").cast("int")))).select(*docs.columns)

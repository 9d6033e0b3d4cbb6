"""Sharding by a k-d tree over document metadata.

Each node splits along its widest dimension at a weighted quantile, until a leaf holds about the
target bytes.  A level of the tree is a handful of small aggregations over a written table of
metadata (no text): one for the extents of all nodes, and a radix search of the quantiles of all
nodes at once, whose histograms of at most nodes x 4096 rows stay in Spark: a row for each node comes
back.  Cuts are joined as a table of at most as many rows as shards.

Null texts weigh nothing but the fixed 16 bytes a row.  Null metadata count as 0.  Ties on a
dimension are broken by a hash of the row and its place in the input, so rows equal in id and text can
part too.  Slots number the rows of a shard from 0, by (id, text checksum).  Very long texts are never
cut; an empty table gives an empty result; further columns are not read and cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_running_sum, written

BITS = 12
ROUNDS = 4
HALF = 1 << (BITS * ROUNDS // 2)


def kd_assign(meta: DataFrame, dims: list[str], size: str, tie: Column, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Add ``shard`` to a written table ``meta``; ``dims`` are its numeric columns without nulls.

    Give ``shards``, or ``target_bytes`` for as many leaves as the total needs.
    """
    spark = meta.sparkSession
    total = meta.agg(F.sum(size)).first()[0] or 0
    shards = shards or max(1, -(-int(total) // int(target_bytes)))
    base = meta.withColumn("_tie", tie).withColumn("_node", F.lit(0).cast("long"))
    ext = base.agg(*[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = [max(1e-12, (ext[f"hi_{i}"] or 0) - (ext[f"lo_{i}"] or 0)) for i in range(len(dims))]
    leaves, first = {0: shards}, {0: 0}  # by node: its leaves, and its first shard
    now = base
    while any(n > 1 for n in leaves.values()):
        split = {k: n for k, n in leaves.items() if n > 1}
        rows = now.groupBy("_node").agg(F.sum(size).alias("w"), *[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        seen = {r["_node"]: r for r in rows}
        plan = []
        for k, n in split.items():
            if r := seen.get(k):
                spread = [(r[f"hi_{i}"] - r[f"lo_{i}"]) / whole[i] for i in range(len(dims))]
                d = int(np.argmax(spread))
                plan.append((k, d, r[f"lo_{d}"], max(1e-12, r[f"hi_{d}"] - r[f"lo_{d}"]), float(r["w"]) * (n // 2) / n))
        if not plan:
            break
        # at most one row for each shard
        how = F.broadcast(spark.createDataFrame([p[:4] for p in plan], "_node long, _dim int, _lo double, _span double"))
        value = F.get(F.array(*[F.col(c).cast("double") for c in dims]), F.col("_dim"))
        place = F.least(F.floor((value - F.col("_lo")) / F.col("_span") * (HALF - 1)), F.lit(HALF - 1)).cast("long")
        keyed = now.join(how, "_node", "left").withColumn("_key", place * HALF + F.pmod(F.col("_tie"), F.lit(HALF)))
        prefix, below, at_cut = {p[0]: 0 for p in plan}, {p[0]: 0.0 for p in plan}, {}
        want = {p[0]: p[4] for p in plan}
        for r in range(ROUNDS):
            shift = BITS * (ROUNDS - 1 - r)
            at = F.broadcast(spark.createDataFrame([(k, prefix[k], want[k] - below[k]) for k in prefix], "_n long, _prefix long, _want double"))
            hist = keyed.join(at, F.col("_node") == F.col("_n")).filter(F.shiftright("_key", shift + BITS) == F.col("_prefix")).groupBy("_node", "_want", F.shiftright("_key", shift).alias("bin")).agg(F.sum(size).alias("w"))
            upto = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("bin")))  # at most 4096 bins a node
            one = F.struct("bin", (F.col("upto") - F.col("w")).alias("before"), "w")
            for r in upto.groupBy("_node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("_want"), one)), F.max(one)).alias("s")).collect():  # a row for each node
                prefix[r["_node"]], at_cut[r["_node"]] = r["s"]["bin"], r["s"]["w"]
                below[r["_node"]] += r["s"]["before"]
        # a key equal to the cut goes left if that comes nearer to the wanted weight; the bin's weight is the last round's
        cut = {}
        for node in prefix:
            w = at_cut.get(node, 0)
            cut[node] = prefix[node] if below[node] + w - want[node] <= want[node] - below[node] else prefix[node] - 1
        ends = F.broadcast(spark.createDataFrame(list(cut.items()), "_n long, _cut long"))
        nxt = keyed.join(ends, F.col("_node") == F.col("_n"), "left").withColumn("_node", F.when(F.col("_cut").isNull(), F.col("_node") * 2).when(F.col("_key") <= F.col("_cut"), F.col("_node") * 2).otherwise(F.col("_node") * 2 + 1))
        now = written(nxt.select(*meta.columns, "_tie", "_node"), "kd-level")
        new_leaves, new_first = {}, {}
        for k, n in leaves.items():
            if k in cut:
                new_leaves |= {2 * k: n // 2, 2 * k + 1: n - n // 2}
                new_first |= {2 * k: first[k], 2 * k + 1: first[k] + n // 2}
            else:
                new_leaves[2 * k], new_first[2 * k] = n if n == 1 or k not in seen else 1, first[k]
        leaves, first = new_leaves, new_first
    names = F.broadcast(spark.createDataFrame(list(first.items()), "_n long, shard int"))
    return now.join(names, F.col("_node") == F.col("_n")).drop("_n", "_node", "_tie")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each document; dimensions: length, id, source and language."""
    name = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + 16
    meta = written(docs.select(id_col, size.alias("size"), F.crc32(raw).alias("text_crc32"), F.log2(size.cast("double")).alias("d_length"), F.coalesce(F.col(id_col).cast("double"), F.lit(0.0)).alias("d_id"), name(source_col).alias("d_source"), name(lang_col).alias("d_lang"), F.monotonically_increasing_id().alias("_copy")), "kd-meta")
    put = kd_assign(meta, ["d_length", "d_id", "d_source", "d_lang"], "size", F.xxhash64(id_col, "text_crc32", "_copy"), shards, target_bytes)
    one = put.select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.lit(1).cast("long").alias("_one"))
    slotted = with_running_sum(one, ["shard"], [id_col, "text_crc32"], "_one", "_slot", "kd-slots")
    return slotted.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

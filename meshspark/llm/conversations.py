"""Repair of conversation structure by cheapest edits, found on a bidirectional tight-arc graph.

A conversation's turns are to read as an optional system turn and user and assistant turns in
alternation, from a user's to an assistant's, or as nothing.  A node is a number of turns read and a
state of that pattern; arcs keep, delete or rerole the next turn, or insert an empty one.  Forward and backward least
costs mark the arcs of cheapest repairs, and a traversal that carries the set of nodes reached by one
sequence of edits takes the least edit letter at each step, so ties end at the ASCII-least audit.

All that a turn brings to this is its role's initial, whether it must go and whether it is truncated: one
letter, so a conversation is a short string.  Strings are cut in chunks of ``CHUNK`` turns.  Where a
conversation has more, a chunk is summed up as a 4 x 4 matrix of least costs and as a map of node sets,
and only these meet by conversation: a conversation with a third of all rows is spread over tasks.

Defined cases: null ids are one conversation; null roles and texts are a space, so null texts are blank; an
empty role has no initial; turns of equal number follow each other by (role, text digest), null numbers
first; rows equal in all columns are duplicates; very long texts are never cut; an empty table gives an
empty result; further columns are ignored.  A conversation that the damage removes whole is reported with zeros.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 1 << 14
SPACE = " \t\n\x0b\f\r"
FAR = 1 << 60
#: The state after a turn: 0 none yet, 1 system, 2 user, 3 assistant.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, ACCEPT = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)


def turn_arcs(kind: str) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) over one turn; ``x`` must go, a capital is truncated."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if kind != "x":
        more = TRUNCATED * kind.isupper()
        out += [("K", p, q, KEEP_COST + more) for p, q in KEEP[kind.lower()].items()]
        out += [("R", p, q, REROLE + more) for p, q in NEXT.items()]
    return out


ARCS = {k: turn_arcs(k) for k in "xsuaoSUAO"}


def inserted(f: list) -> list:
    """Least costs with insertions at one place, from the costs without."""
    u = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    return [f[0], f[1], u, min(f[3], u + INSERT)]


def inserted_back(b: list) -> list:
    u = min(b[2], b[3] + INSERT)
    return [min(b[0], u + INSERT), min(b[1], u + INSERT), u, min(b[3], u + INSERT)]


def forward(kinds: str, start) -> list[list]:
    out = [inserted(list(start))]
    for k in kinds:
        f = [FAR] * 4
        for _, p, q, c in ARCS[k]:
            f[q] = min(f[q], out[-1][p] + c)
        out.append(inserted(f))
    return out


def backward(kinds: str, end) -> list[list]:
    out = [inserted_back(list(end))]
    for k in reversed(kinds):
        b = [FAR] * 4
        for _, p, q, c in ARCS[k]:
            b[p] = min(b[p], out[-1][q] + c)
        out.append(inserted_back(b))
    return out[::-1]


def traverse(kinds: str, f: list, b: list, total: int, at: set, last: bool, edits: list | None = None) -> set:
    """From the nodes ``at``, the least letter of a tight arc at each step; the nodes reached.

    ``edits`` gets for each turn (roles inserted before, letter, new role or "", roles inserted after).
    Insertions after the last turn belong to the next chunk, unless this one is the ``last``.
    """
    tight = lambda i, p, j, q, c: f[i][p] + c + b[j][q] == total
    i, before = 0, []
    while i < len(kinds) or last:
        steps: dict[str, set] = {}
        if i < len(kinds):
            for letter, p, q, c in ARCS[kinds[i]]:
                if p in at and tight(i, p, i + 1, q, c):
                    steps.setdefault(letter, set()).add(q)
        for p, q in NEXT.items():
            if p in at and tight(i, p, i, q, INSERT):
                steps.setdefault("I", set()).add(q)
        if not steps:
            break
        letter = min(steps)
        at = steps[letter]
        if letter == "I":
            before.append(ROLES[min(at)])
            continue
        if edits is not None:
            edits.append([before, letter, ROLES[min(at)] if letter == "R" else "", []])
        i, before = i + 1, []
    if edits and before:
        edits[-1][3] = before
    return at


@lru_cache(1 << 16)
def chunk_matrix(kinds: str) -> tuple:
    return tuple(tuple(forward(kinds, [0 if q == p else FAR for q in range(4)])[-1]) for p in range(4))


@lru_cache(1 << 16)
def chunk_sets(kinds: str, start: tuple, end: tuple, total: int, last: bool) -> tuple:
    """The node set reached from each node set, as bits."""
    f, b = forward(kinds, start), backward(kinds, end)
    sets = [{q for q in range(4) if m >> q & 1} for m in range(16)]
    return tuple(sum(1 << q for q in traverse(kinds, f, b, total, s, last)) for s in sets)


@lru_cache(1 << 16)
def chunk_edits(kinds: str, start: tuple, end: tuple, at: int, last: bool) -> tuple:
    """(total cost of the conversation, audit of this chunk, edits of its turns)."""
    f, b = forward(kinds, start), backward(kinds, end)
    total = min(x + y for x, y in zip(f[0], b[0]))
    edits: list = []
    traverse(kinds, f, b, total, {q for q in range(4) if at >> q & 1}, last, edits)
    audit = "".join("I" * len(x[0]) + x[1] + "I" * len(x[3]) for x in edits)
    return total, audit, edits


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(``conv_id:turn``) % 20; see the cases in the code."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    put = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    times = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    role = F.when(kind == 4, F.lit("user")).otherwise(text("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), put.alias("text"), F.when(times > 0, F.sequence(F.lit(1), times)).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode("copies").alias("_")).drop("_")


def conversation_key(c: Column) -> Column:
    """Text that stands for an id; empty for null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


@dataclass
class Repaired:
    """``report``: a row for each conversation; ``turns``: (_c, _pos, seq, role, text) of the repaired ones in order."""

    report: DataFrame
    turns: DataFrame


EDITS = "array<struct<before: array<string>, letter: string, role: string, after: array<string>>>"


def _edit_frames(frames):
    for pdf in frames:
        got = [chunk_edits(k, tuple(s), tuple(e), int(at), bool(last)) for k, s, e, at, last in zip(pdf["kinds"], pdf["start"], pdf["end"], pdf["at"], pdf["last"])]
        edits = [[{"before": b, "letter": x, "role": r, "after": a} for b, x, r, a in g[2]] for g in got]
        yield pdf[["_c", "_chunk"]].assign(cost=[g[0] for g in got], audit=[g[1] for g in got], edits=edits)


def _matrix_frames(frames):
    for pdf in frames:
        yield pdf.assign(matrix=[[x for row in chunk_matrix(k) for x in row] for k in pdf["kinds"]])


def _set_frames(frames):
    for pdf in frames:
        yield pdf.assign(sets=[list(chunk_sets(k, tuple(s), tuple(e), int(t), bool(last))) for k, s, e, t, last in zip(pdf["kinds"], pdf["start"], pdf["end"], pdf["total"], pdf["last"])])


def _join_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's chunks: least costs before and after each, from the chunks' matrices."""
    pdf = pdf.sort_values("_chunk")
    m = [np.array(x).reshape(4, 4) for x in pdf["matrix"]]
    start, end = [np.array(START)], [np.array(ACCEPT)]
    for x in m[:-1]:
        start.append(np.minimum((start[-1][:, None] + x).min(0), FAR))
    for x in m[:0:-1]:
        end.append(np.minimum((x + end[-1][None, :]).min(1), FAR))
    total = int((start[-1][:, None] + m[-1] + np.array(ACCEPT)[None, :]).min())
    return pdf[["_c", "_chunk"]].assign(start=[x.tolist() for x in start], end=[x.tolist() for x in end[::-1]], total=total, last=[False] * (len(m) - 1) + [True])


def _join_sets(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_chunk")
    at = [1]
    for s in list(pdf["sets"])[:-1]:
        at.append(int(s[at[-1]]))
    return pdf[["_c", "_chunk"]].assign(at=at)


def _long_edits(many: DataFrame) -> DataFrame:
    """Edits of conversations of several chunks; what meets by conversation is a row for ``CHUNK`` turns."""
    costs = "array<long>"
    matrices = many.mapInPandas(_matrix_frames, f"_c string, _chunk long, kinds string, matrix {costs}")
    ends = matrices.select("_c", "_chunk", "matrix").groupBy("_c").applyInPandas(_join_costs, f"_c string, _chunk long, start {costs}, end {costs}, total long, last boolean")
    ready = written(many.join(ends, ["_c", "_chunk"]), "conv-costs")
    sets = ready.mapInPandas(_set_frames, f"_c string, _chunk long, kinds string, start {costs}, end {costs}, total long, last boolean, sets array<int>")
    at = sets.select("_c", "_chunk", "sets").groupBy("_c").applyInPandas(_join_sets, "_c string, _chunk long, at int")
    return ready.drop("total").join(at, ["_c", "_chunk"])


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repaired:
    """``rows`` (conv_id, turn, role, text): faults, cheapest edits and the repaired turns of each conversation."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    order = ["_c", "turn", "role", "_digest", "_salt"]
    base = rows.select(conversation_key(F.col("conv_id")).alias("_c"), "turn", text("role").alias("role"), text("text").alias("text")).withColumn("_digest", F.unhex(F.md5(F.col("text").cast("binary")))).withColumn("_salt", F.monotonically_increasing_id())
    # rows in order, numbered upwards from partition to partition
    staged = written(base.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()).drop("_salt"), "conv-rows", "zstd")
    bare = F.rtrim("text", F.lit(SPACE))
    light = staged.select("_c", "_pos", "turn", F.substring("role", 1, 1).alias("initial"), "role", "_digest", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    seen = light.groupBy("_c", "role", "_digest").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("blank"), 1).when(F.col("_first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    faulty = light.join(seen, "_pos", "left").select("_c", "_pos", "turn", "initial", fault.alias("fault"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    kind = F.when(F.col("fault").isin(1, 2), F.lit("x")).when(F.col("fault") == 3, F.upper(letter)).otherwise(letter)
    by_chunk = faulty.groupBy("_c", F.floor(F.col("_pos") / chunk).cast("long").alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", kind.alias("kind"), "initial"))).alias("l"),
        *[F.count_if(F.col("fault") == i).alias(n) for i, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
    )
    pair = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l") - 1), lambda a, b: F.when(F.concat(a["initial"], b["initial"]).isin("su", "ua", "au"), 0).otherwise(1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    chunks = written(by_chunk.select("_c", "_chunk", F.array_join(F.transform("l", lambda x: x["kind"]), "").alias("kinds"), F.transform("l", lambda x: x["_pos"]).alias("at_pos"), F.element_at("l", 1)["initial"].alias("head"), F.element_at("l", -1)["initial"].alias("tail"), F.when(F.size("l") > 1, total(pair)).otherwise(0).alias("illegal"), "blank", "duplicate", "truncated"), "conv-chunks")
    per = chunks.groupBy("_c").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.struct("_chunk", "head", "tail"))).alias("l"))
    seam = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l") - 1), lambda a, b: F.when(F.concat(a["tail"], b["head"]).isin("su", "ua", "au"), 0).otherwise(1))
    per = written(per.select("_c", "blank", "duplicate", "truncated", (F.col("illegal") + F.when(F.size("l") > 1, total(seam)).otherwise(0)).alias("illegal"), F.size("l").alias("n_chunks")), "conv-faults")
    vector = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    sized = chunks.select("_c", "_chunk", "kinds").join(per.select("_c", "n_chunks"), "_c")
    one = sized.filter("n_chunks = 1").select("_c", "_chunk", "kinds", vector(START).alias("start"), vector(ACCEPT).alias("end"), F.lit(True).alias("last"), F.lit(1).alias("at"))
    many = _long_edits(sized.filter("n_chunks > 1").drop("n_chunks"))
    edits = written(one.unionByName(many).mapInPandas(_edit_frames, f"_c string, _chunk long, cost long, audit string, edits {EDITS}"), "conv-edits")
    audits = edits.groupBy("_c").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    spread = F.when(F.max("turn").isNull(), 0).otherwise(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    report = per.drop("n_chunks").join(audits, "_c").join(faulty.groupBy("_c").agg(spread.alias("gaps")), "_c")

    each = edits.join(chunks.select("_c", "_chunk", "at_pos"), ["_c", "_chunk"]).select(F.explode(F.arrays_zip(F.col("at_pos"), F.col("edits"))).alias("e")).select(F.col("e.at_pos").alias("_pos"), "e.edits.*")
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("letter") == "D", F.array().cast("array<struct<role: string, text: string>>")).otherwise(F.array(F.struct(F.when(F.col("letter") == "R", F.col("e_role")).otherwise(F.col("role")).alias("role"), F.col("text"))))
    whole = staged.select("_c", "_pos", "role", "text").join(each.withColumnRenamed("role", "e_role"), "_pos")
    turns = whole.select("_c", "_pos", F.posexplode(F.concat(empty("before"), own, empty("after"))).alias("seq", "t")).select("_c", "_pos", "seq", "t.*")
    return Repaired(report, turns)


def _digest_batches(batches):
    """Sorted by conversation in, one digest for each out; of a long conversation only a batch is held."""
    now, digest, out = None, None, []

    def flush():
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["_c", "sha256"])

    for batch in batches:
        for c, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist()):
            if c != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = c, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n")
                digest.update(line.encode())
        if len(out) >= 1000:
            yield flush()
    if digest:
        out.append((now, digest.hexdigest()))
    yield flush()


def digests(turns: DataFrame) -> DataFrame:
    """(_c, sha256) of the repaired ``role:text`` lines; a digest cannot be split, so a conversation streams through one task."""
    lines = turns.select("_c", "_pos", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("_c").sortWithinPartitions("_c", "_pos", "seq").select("_c", "line").mapInArrow(_digest_batches, "_c string, sha256 string")


def repaired_conversations(rows: DataFrame, damaged: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation of ``rows``."""
    got = repair(damage(rows) if damaged else rows, chunk)
    ids = rows.select("conv_id").distinct().withColumn("_c", conversation_key(F.col("conv_id")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ids.join(got.report, "_c", "left").join(digests(got.turns), "_c", "left")
    return out.select("conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

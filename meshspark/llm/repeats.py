"""Passages that start more than once in a corpus, found with suffix arrays of shards and removed.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in another
document or the same one.  Equal strings must meet in one shard, so a window of ``length`` bytes is
dealt by the least hash of its grams of ``gram`` bytes, which depends on the window's content alone.
Successive windows of one hash are a segment; segments whose gram occurs once in the corpus hold no
repeat.  Segments that are equal are brought together before the shuffle, one of each is sorted and
the finds go back to all.  A task sorts the segments of its hashes, shard after shard, by
``induced.repeated``, whose queues lie on disk beyond a fixed number of tuples.  A hash with over
``hot_bytes`` of different segments is not left to one task: its windows meet by a 128-bit digest.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` stay
whole; rows equal in id and text are copies of each other, so both lose what is long enough; null
and repeated ids are documents of their own; bytes are judged, so a cut may fall inside a character;
an empty table gives an empty result.  The input's columns are kept in the struct ``doc``, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, with_groups, written
from .induced import repeated

PIECE = 1 << 18
#: Bytes of segments that a task sorts at a time, where they are not all of one hash.
SHARD_BYTES = 2 << 20
#: Bytes of different segments of one hash beyond which its windows are dealt to all tasks.
HOT_BYTES = SHARD_BYTES
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each position."""
    with np.errstate(over="ignore"):
        h, step, power = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, ODD
        h ^= h >> np.uint64(32)
        while step < gram:
            h = h[:-step] * power + h[step:]
            step, power = 2 * step, power * power
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sliding(f: np.ufunc, v: np.ndarray, width: int, fill) -> np.ndarray:
    """``f`` over v[i : i + width] for each i, by running values of blocks from both sides."""
    n = len(v)
    rows = np.concatenate([v, np.full(-n % width, fill, v.dtype)]).reshape(-1, width)
    left, right = f.accumulate(rows, 1).ravel(), f.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return f(right[: n - width + 1], left[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(first window, windows, hash, occurrences of its gram) of each segment; ``ends`` of the texts that ``data`` joins."""
    width = length - gram + 1
    h = gram_hashes(data, gram)
    least = sliding(np.minimum, h, width, np.uint64(0xFFFFFFFFFFFFFFFF))
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    inside = np.arange(len(least)) + length <= ends[text]
    cut = np.flatnonzero((least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])) + 1
    first, last = np.append(0, cut), np.append(cut, len(least))
    mine = inside[first]
    first, n = first[mine], (last - first)[mine]
    value = least[first]
    # a gram is chosen if it is the least of some window that holds it
    chosen = np.where(inside, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, chosen, pad]), width, np.uint64(0)) == h)
    names, which = np.unique(h[at], return_inverse=True)
    key, mine = np.sort(which * np.int64(len(data)) + at), np.searchsorted(names, value) * np.int64(len(data))
    seen = np.searchsorted(key, mine + first + n + width - 1) - np.searchsorted(key, mine + first)
    return first, n, value.view(np.int64), seen


def _pieces(batches, length: int):
    """Texts in pieces of about PIECE bytes: (rows, offsets in their texts, joined bytes, ends); long texts overlap by length - 1."""
    rows, base, parts, size = [], [], [], 0
    for batch in batches:
        for row, raw in zip(batch.column("_row").to_pylist(), batch.column("raw")):
            view = np.frombuffer(raw.as_buffer(), np.uint8)
            for a in range(0, len(view) - length + 1, PIECE):
                part = view[a : a + PIECE + length - 1]
                rows.append(row), base.append(a), parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield np.array(rows), np.array(base), np.concatenate(parts), np.cumsum([len(p) for p in parts])
                    rows, base, parts, size = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(base), np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _segment_batches(length: int, gram: int):
    def work(batches):
        for rows, base, data, ends in _pieces(batches, length):
            first, n, value, seen = segments(data, ends, length, gram)
            text = np.searchsorted(ends, first, "right")
            begin = first - np.append(0, ends)[text] + base[text]
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(rows[text], pa.int64()), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seen.astype(np.int64))], ["v", "_row", "start", "windows", "seen"])

    return work


SPANS = "array<struct<start: int, windows: int>>"
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())]))


def spans_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "windows": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def sort_shard(texts: list, length: int) -> list[np.ndarray]:
    """For each text, whether each of its windows also starts elsewhere in these texts."""
    sizes = np.array([len(t) for t in texts])
    shard = np.empty(int(sizes.sum()) + len(texts) + 1, np.int32)
    at, out = 0, []
    for t in texts:
        shard[at : at + len(t)] = t
        shard[at : at + len(t)] += 2
        shard[at + len(t)] = 1
        at += len(t) + 1
    shard[-1] = 0
    twice = repeated(shard, length)
    at = 0
    for t in texts:
        out.append(twice[at : at + len(t) - length + 1])
        at += len(t) + 1
    return out


def _sort_batches(length: int):
    """Sorted by hash in, finds out; segments alone under a hash whose gram they hold once need no sorting."""

    def done(held):
        texts = [(i, np.frombuffer(t.column("seg")[i].as_buffer(), np.uint8), t) for t in held for i in range(t.num_rows)]
        flags = sort_shard([x[1] for x in texts], length)
        return [(t, i, f) for (i, _, t), f in zip(texts, flags)]

    def rows(finds):
        finds = [(t, i, f | (t.column("members")[i].as_py() > 1)) for t, i, f in finds]
        finds = [(t, i, f) for t, i, f in finds if f.any()]
        take = lambda c: pa.array([t.column(c)[i].as_py() for t, i, _ in finds], held_types[c])
        if finds:
            yield pa.RecordBatch.from_arrays([take("v"), take("digest"), take("members"), pa.array([spans_of(f) for *_, f in finds], FOUND)], ["v", "digest", "members", "spans"])

    held_types = {"v": pa.int64(), "digest": pa.binary(), "members": pa.int64()}

    def work(batches):
        held, size, plain = [], 0, []
        for group in blocks(batches, "v"):
            if group.num_rows == 1 and group.column("seen")[0].as_py() == 1:
                if group.column("members")[0].as_py() > 1:
                    plain.append((group, 0, np.ones(group.column("windows")[0].as_py(), bool)))
                    if len(plain) >= 1000:
                        yield from rows(plain)
                        plain = []
                continue
            held.append(group)
            size += group.nbytes
            if size >= SHARD_BYTES:
                yield from rows(done(held))
                held, size = [], 0
        yield from rows(plain)
        if held:
            yield from rows(done(held))

    return work


def _window_batches(length: int):
    def work(batches):
        for batch in batches:
            for v, digest, raw in zip(batch.column("v"), batch.column("digest"), batch.column("seg")):
                raw = raw.as_buffer().to_pybytes()
                n = len(raw) - length + 1
                keys = [hashlib.md5(raw[i : i + length]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([v.as_py()] * n, pa.int64()), pa.array([digest.as_py()] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(keys, pa.binary())], ["v", "digest", "start", "window"])

    return work


def _hot_finds(distinct: DataFrame, length: int) -> DataFrame:
    """The finds of segments whose hash has too many of them for a task, by digests of their windows."""
    windows = written(distinct.select("v", "digest", "seg").mapInArrow(_window_batches(length), "v long, digest binary, start int, window binary"), "repeats-windows", "zstd")
    twice = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeats-twice")
    hit = with_groups(windows, twice, ["window"], "n").groupBy("v", "digest").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(1).alias("windows")))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("windows")))
    at = distinct.select("v", "digest", "members", "windows").join(hit, ["v", "digest"], "left")
    return at.select("v", "digest", "members", F.when(F.col("members") > 1, whole).otherwise(F.col("spans")).cast(SPANS).alias("spans")).filter("spans is not null")


def cut_texts(raw, spans, length: int):
    """Kept bytes and removed runs (from, to) of each text, from its repeated windows in any order."""
    kept, runs = [], []
    for text, found in zip(raw, spans):
        if text is None:
            kept.append(None), runs.append(None)
            continue
        at = np.array([(s["start"], s["windows"]) for s in found], np.int64)
        at = at[np.argsort(at[:, 0], kind="stable")]
        begin, end = at[:, 0], np.maximum.accumulate(at[:, 0] + at[:, 1] + length - 1)
        head = np.append(True, begin[1:] > end[:-1])
        begin, end = begin[head], end[np.append(head[1:], True)]
        pieces, last = [], 0
        for a, b in zip(begin.tolist(), end.tolist()):
            pieces.append(text[last:a])
            last = b
        kept.append(b"".join([*pieces, text[last:]]))
        runs.append([{"from": a, "to": b} for a, b in zip(begin.tolist(), end.tolist())])
    return pd.DataFrame({"kept": kept, "runs": runs})


def _cutter(length: int):
    def cut(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return cut_texts(raw, spans, length)

    return cut


def without_repeats(docs: DataFrame, length: int = 400, gram: int = 128, hot_bytes: int = HOT_BYTES, text_col: str = "text") -> DataFrame:
    """(doc, n_bytes, kept, runs): each row as a struct, its bytes without the removed runs (from, to) and these runs."""
    base = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "repeats-docs", "zstd")
    raw = F.coalesce(F.col(f"doc.{text_col}").cast("binary"), F.lit(bytearray()))
    long = base.select("_row", raw.alias("raw")).filter(F.octet_length("raw") >= length)
    runs = written(long.mapInArrow(_segment_batches(length, gram), "v long, _row long, start int, windows int, seen long"), "repeats-runs", batch_rows=500)
    again = written(runs.groupBy("v").agg(F.sum("seen").alias("n")).filter("n > 1"), "repeats-again")
    by_doc = with_groups(runs, again, ["v"], "n").groupBy("_row").agg(F.collect_list(F.struct("v", "start", "windows", "seen")).alias("runs"))
    piece = F.transform("runs", lambda r: F.struct(r["v"].alias("v"), r["start"].alias("start"), r["windows"].alias("windows"), r["seen"].alias("seen"), F.substring(F.col("raw"), r["start"] + 1, r["windows"] + length - 1).alias("seg")))
    parts = long.join(by_doc, "_row").select("_row", F.explode(piece).alias("p")).select("_row", "p.*")
    segs = written(parts.withColumn("digest", F.unhex(F.md5("seg"))), "repeats-segments", "zstd")
    distinct = written(segs.groupBy("v", "digest").agg(F.first("seg").alias("seg"), F.first("windows").alias("windows"), F.first("seen").alias("seen"), F.count(F.lit(1)).alias("members")), "repeats-distinct", "zstd")
    # at most (bytes of segments / hot_bytes) rows
    hot = distinct.groupBy("v").agg(F.sum(F.octet_length("seg")).alias("b")).filter(F.col("b") > hot_bytes).select("v")
    many = not hot.isEmpty()
    some = distinct.join(F.broadcast(hot), "v", "left_anti") if many else distinct
    found = some.repartition("v").sortWithinPartitions("v").mapInArrow(_sort_batches(length), f"v long, digest binary, members long, spans {SPANS}")
    if many:
        found = found.unionByName(_hot_finds(distinct.join(F.broadcast(hot), "v"), length))
    found = written(found, "repeats-found", batch_rows=500)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), s["windows"].alias("windows")))
    hits = with_groups(segs.select("v", "digest", "_row", "start"), found, ["v", "digest"], "members").groupBy("_row").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    cut = F.pandas_udf(_cutter(length), "kept binary, runs array<struct<from: int, to: int>>")
    both = base.join(hits, "_row", "left").withColumn("raw", raw)
    out = both.withColumn("cut", cut(F.when(F.col("spans").isNotNull(), F.col("raw")), "spans"))
    return out.select("doc", F.octet_length("raw").cast("long").alias("n_bytes"), F.coalesce("cut.kept", "raw").alias("kept"), F.coalesce("cut.runs", F.array().cast("array<struct<from: int, to: int>>")).alias("runs"))

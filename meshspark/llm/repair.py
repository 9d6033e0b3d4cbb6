"""Token-id shards compressed with Re-Pair grammars, with random access to documents.

A shard is one binary blob (rows of a Parquet table, so Spark's commit protocol covers lost
executors and any store that Spark can write to).  Pairs of adjacent symbols that are frequent in
the shard become rules, round after round; no rule crosses a document's end.

Blob layout, little-endian: magic ``RPG1``; u32 documents, rules, symbols; i64 document ids; u8
flags (1: null id); u32 tokens of each document; u32 symbols of each document; u32 left and right of
each rule; u32 expansion length of each rule; u32 symbols.  Rule k is symbol ``base + k``; ``base``
(u32, after the counts) is above every token id.

Null and empty texts: a document of the end id alone.  Repeated ids stay separate documents, ordered
by (id, text).  An empty table gives no shards.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import library_encoder
from .common import with_running_sum, written

MAGIC = b"RPG1"
SLOTS = 1 << 18

SHARDS = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("blob", T.BinaryType())])


def pair_slots(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """The slot of each pair; every turn hashes anew, so pairs that met in one slot part in the next turn."""
    odd = np.uint32((0x85EBCA6B + 0x3C6EF372 * turn) & 0xFFFFFFFF | 1)
    x = a * np.uint32(0x9E3779B1)
    x ^= b * odd
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x >>= np.uint32(32 - SLOTS.bit_length() + 1)
    return x.astype(np.int32)


def compress(seq: np.ndarray, ends: np.ndarray, base: int, rounds: int = 4, rules_per_round: int = 4096, least: int = 8):
    """Re-Pair: ``seq`` as symbols, where each document ends in it, and rules (left, right).

    A round hashes the pairs inside documents to slots, each of which counts one of its pairs exactly;
    the most frequent of these become rules.
    """
    seq, left, right = seq.astype(np.uint32), [], []
    made = 0
    for turn in range(rounds):
        if len(seq) < 2:
            break
        a, b = seq[:-1], seq[1:]
        slot = pair_slots(a, b, turn)
        slot[ends[(ends > 0) & (ends < len(seq))] - 1] = SLOTS  # of pairs over a document's end
        first_of, second_of = np.zeros(SLOTS + 1, np.uint32), np.zeros(SLOTS + 1, np.uint32)
        first_of[slot], second_of[slot] = a, b  # the last pair of each slot
        counted = first_of[slot] == a
        counted &= second_of[slot] == b
        count = np.bincount(slot[counted], minlength=SLOTS + 1)[:SLOTS]
        best = np.flatnonzero(count >= least)
        best = best[np.argsort(-count[best], kind="stable")][:rules_per_round]
        if not len(best):
            break
        rule = np.zeros(SLOTS + 1, np.uint32)
        rule[best] = base + made + np.arange(len(best), dtype=np.uint32)
        symbol = rule[slot]
        symbol *= counted
        hit = np.flatnonzero(symbol).astype(np.int32)
        # of overlapping hits in a row, every other one from the first is replaced
        at = np.arange(len(hit), dtype=np.int32)
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=np.int32(-2)) > 1, at, np.int32(0)))
        hit = hit[((at - run) & 1) == 0]
        seq[hit] = symbol[hit]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, ends = seq[keep], ends - np.searchsorted(hit, ends)
        left.append(first_of[best])
        right.append(second_of[best])
        made += len(best)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return seq, ends, cat(left), cat(right)


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Tokens of each rule; a rule's parts are tokens or earlier rules."""
    n: list[int] = []
    for a, b in zip(left.tolist(), right.tolist()):
        n.append((n[a - base] if a >= base else 1) + (n[b - base] if b >= base else 1))
    return np.array(n, np.uint32)


def expanded_rules(left, right, lengths, base):
    """All rules' expansions in one array, and where each starts."""
    start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.zeros(start[-1], np.uint32)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        at = start[k]
        for x in (a, b):
            if x >= base:
                n = lengths[x - base]
                flat[at : at + n] = flat[start[x - base] : start[x - base] + n]
            else:
                n = 1
                flat[at] = x
            at += n
    return flat, start


def pack(ids: list, seqs: list[np.ndarray], rounds: int) -> bytes:
    """One shard's blob from document ids and their token ids."""
    lengths = np.array([len(s) for s in seqs], np.uint32).reshape(len(ids), -1).sum(axis=1, dtype=np.uint32)  # a document may come in pieces, as many as any other
    seq = np.concatenate([np.zeros(0, "<u4"), *seqs]).astype("<u4")
    base = int(seq.max(initial=0)) + 1
    sym, ends, left, right = compress(seq, np.cumsum(lengths, dtype=np.int64), base, rounds)
    n_sym = np.diff(ends, prepend=0).astype(np.uint32)
    null = np.array([i is None for i in ids], np.uint8)
    own = np.array([0 if i is None else i for i in ids], np.int64)
    head = MAGIC + struct.pack("<4I", len(ids), len(left), len(sym), base)
    return head + b"".join(x.tobytes() for x in (own, null, lengths, n_sym, left, right, expansion_lengths(left, right, base), sym))


class Shard:
    """Random access: ``tokens(i)`` expands document i alone."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        n, rules, symbols, self.base = struct.unpack_from("<4I", blob, 4)
        at = 20

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(blob, kind, count, at)
            at += x.nbytes
            return x

        self.ids, self.null, self.lengths, n_sym = take("<i8", n), take("u1", n), take("<u4", n), take("<u4", n)
        left, right, self.rule_lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.symbols = take("<u4", symbols)
        self.offset = np.concatenate([[0], np.cumsum(n_sym, dtype=np.int64)])
        flat, self.start = expanded_rules(left, right, self.rule_lengths, self.base)
        self.flat = flat

    def tokens(self, i: int) -> np.ndarray:
        return self.stretch(i, i + 1)

    def stretch(self, i: int, j: int) -> np.ndarray:
        """Tokens of documents i to j - 1, expanded from their symbols alone."""
        s = self.symbols[self.offset[i] : self.offset[j]]
        ruled = s >= self.base
        at = np.flatnonzero(ruled)
        if not len(at):
            return s
        k = s[at] - self.base
        n = np.ones(len(s), np.int64)
        n[at] = self.rule_lengths[k]
        end = np.cumsum(n)
        source = np.arange(len(self.flat), len(self.flat) + len(s))  # a token stands for itself, behind the rules' expansions
        source[at] = self.start[k]
        return np.concatenate([self.flat, s])[np.repeat(source - (end - n), n) + np.arange(end[-1])]

    def stretches(self, most: int = 1 << 16):
        """(i, j, tokens) for consecutive stretches of about ``most`` tokens that cover all documents."""
        upto, i = np.cumsum(self.lengths, dtype=np.int64), 0
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
            yield i, j, self.stretch(i, j)
            i = j


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = 2_000_000, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, order by id over the whole table, and write grammar shards of about ``shard_tokens``; returns the written table.

    Range partitions by id are encoded and packed in their tasks, so one text at a time and one
    shard's ids are held; (part, seq) orders the shards as the ids are ordered.
    """

    def work(batches):
        import pyarrow as pa

        enc = library_encoder(path)
        end = np.array([end_id], "<u4")
        part, seq, ids, seqs, size = None, 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(ids)]), pa.array([size]), pa.array([pack(ids, seqs, rounds)], pa.binary())], schema=out)

        out = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
        for b in batches:
            if b.num_rows and part is None:
                part = b.column(2)[0].as_py()
            for i, t in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids.append(i)
                seqs += [t, end]
                size += len(t) + 1
                if size >= shard_tokens:
                    yield row()
                    seq, ids, seqs, size = seq + 1, [], [], 0
        if ids:
            yield row()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(parts, id_col).sortWithinPartitions(id_col, text_col)
    packed = ranged.select(id_col, text_col, F.spark_partition_id().cast("long").alias("_part")).mapInArrow(work, SHARDS)
    return written(packed, "token-shards", "zstd", batch_rows=10_000)  # units of a batch are looked up once


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, from the files alone: its place, token count and checksum of its ids."""
    sized = with_running_sum(shards.select("part", "seq", "n_tokens"), [], ["part", "seq"], "n_tokens", "_end", "shard-sizes")
    starts = sized.select("part", "seq", (F.col("_end") - F.col("n_tokens")).alias("_start"))

    def work(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            for part, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Shard(blob.as_py())
                n, crc = s.lengths.astype(np.int64), []
                for i, j, tokens in s.stretches():
                    ends = np.cumsum(n[i:j])
                    crc += [zlib.crc32(tokens[a:b]) for a, b in zip((ends - n[i:j]).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.ids, mask=s.null.astype(bool)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()), pa.array([part] * len(n)), pa.array([seq] * len(n))], [id_col, "_at", "n_tokens", "ids_crc32", "part", "seq"])

    schema = f"{id_col} long, _at long, n_tokens long, ids_crc32 long, part long, seq long"
    return shards.select("part", "seq", "blob").mapInArrow(work, schema).join(starts, ["part", "seq"]).select(id_col, (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")

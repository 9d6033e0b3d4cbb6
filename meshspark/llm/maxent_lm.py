"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(leaf | class, history) + log P(word | leaf).
The class is predicted by a softmax over hashed features of the history: the previous word, the
previous two words, a skip feature (the word before the previous one) and the pair of their classes.
Inside a class a second softmax predicts the leaf: its hashed features join the class with the
previous word, the skip word and the pair of classes, on top of the leaf's training share.  A class's
most frequent words are leaves of their own, its other words share leaves by their ending; inside a
shared leaf a word's probability is its share of the leaf's training count, which is the
maximum-entropy solution for word features alone.  The most frequent words of all are classes of
their own, other frequent words share classes by their ending, and the last class, which has no
leaves, holds every other word and one place for unseen words, so the model sums to one over the
vocabulary plus unseen.

Training.  Word counts come from all training tokens.  Both softmaxes are trained in ``ROUNDS`` rounds of
distributed gradient updates, each over its own share of the training documents (all of them in
total): every partition takes stochastic steps from the current weights, and the updates are averaged
by how often each feature row was used, in two shuffled stages that carry used rows only.  Weights
have a fixed size.

Counts of frequent words (one for each of 2^SLOT_BITS slots) are broadcast; all other words meet
their counts in a shuffled join on their 64-bit hash.

Defined cases: null and empty texts are one end token; a null id is hashed as empty text; an empty
table gives an empty result; without training tokens every class is equally likely and words share
one unseen place; repeated rows are scored one by one; very long texts are scored whole.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_remainder, with_groups, written

SLOT_BITS = 19
CLASSES, SINGLES = 32, 12
ROWS = 1 << 13  # hashed rows of each kind of feature
ROUNDS = 2
LEAVES, OWN = 32, 16  # leaves of a class, and how many of them are single words
END = b"\n"
PIECE = 64  # feature rows that are averaged together
SALTS = 8  # groups of tasks whose updates are first summed among themselves
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CACHED = 1024  # feature rows that are updated at a time, so that they stay in a core's cache
BUCKETS = 256  # of word endings, when classes are formed
N_FEATURES = 3 * ROWS + CLASSES * CLASSES
N_ROWS = N_FEATURES + 3 * ROWS  # with those that predict leaves
ROW_TYPE = np.min_scalar_type(N_ROWS)  # short rows sort faster


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only) and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def bucket_of_ending(ending):
    """The bucket of a word's last two bytes (the last byte in the high place)."""
    return (ending * 40503 >> 7) % BUCKETS


def ending_buckets(joined: bytes) -> np.ndarray:
    """The bucket of each word's ending, for words joined by single spaces."""
    raw = np.frombuffer(b"  " + joined + b" ", np.uint8)
    end = np.flatnonzero(raw == 32)[2:]
    last, before = raw[end - 1].astype(np.int64), raw[end - 2].astype(np.int64)
    return bucket_of_ending(np.where(before == 32, last, before | last << 8))


def group_endings(follow: np.ndarray, groups: int) -> np.ndarray:
    """A group for each bucket: buckets are merged pair by pair where the least is lost of what an ending tells of its neighbours."""
    rows = np.concatenate([follow, follow.T], axis=1).astype(float)
    of, alive = np.arange(len(rows)), rows.sum(axis=1) > 0
    of[~alive] = -1
    xlogx = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum(axis=-1)
    own = xlogx(rows) - xlogx(rows.sum(axis=1, keepdims=True))
    loss = lambda i: np.where(alive & (np.arange(len(rows)) != i), own[i] + own - xlogx(rows[i] + rows) + xlogx((rows[i].sum() + rows.sum(axis=1))[:, None]), np.inf)
    cost = np.stack([loss(i) if alive[i] else np.full(len(rows), np.inf) for i in range(len(rows))])
    for _ in range(max(0, int(alive.sum()) - groups)):
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        rows[i] += rows[j]
        own[i], alive[j], of[of == j] = xlogx(rows[i]) - xlogx(rows[i].sum(keepdims=True)), False, i
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = loss(i)
        cost[:, i] = cost[i]
    _, named = np.unique(of, return_inverse=True)
    return (named - (of == -1).any()).clip(0) % groups


def _is_training(doc_id, n: int, held: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n != held


def word_counts(docs: DataFrame, holdout, id_col: str, text_col: str, flush: int = 300_000) -> DataFrame:
    """(h, pair, c, ending): the count of each word in the training documents and, where ``pair``, of each pair of endings of adjacent words."""

    def work(batches):
        from collections import Counter

        import pyarrow as pa

        held: Counter = Counter()
        follow = np.zeros(BUCKETS * BUCKETS, np.int64)

        def out():
            words = list(held)
            ending = [int.from_bytes(w[-2:], "little") for w in words]
            h = word_hashes(words).view(np.int64)
            c = np.fromiter(held.values(), np.int64, len(words))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(ending, pa.int32())], ["h", "c", "ending"])

        for b in batches:
            pairs = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                if _is_training(i, *holdout):
                    words = tokens(text.as_py())
                    held.update(words)
                    e = ending_buckets(b" ".join(words[:-1]))
                    pairs.append(e[:-1] * BUCKETS + e[1:])
                    if len(held) > flush:
                        yield out()
                    if len(pairs) == 256 or len(pairs[-1]) > flush:
                        follow += np.bincount(np.concatenate(pairs), minlength=len(follow))
                        pairs = []
            if pairs:
                follow += np.bincount(np.concatenate(pairs), minlength=len(follow))
        yield out()
        at = np.flatnonzero(follow)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(follow[at]), pa.array(np.full(len(at), -1, np.int32))], ["h", "c", "ending"])

    parts = docs.select(id_col, text_col).mapInArrow(work, "h long, c long, ending int")
    return parts.groupBy("h", (F.col("ending") < 0).alias("pair")).agg(F.sum("c").alias("c"), F.min("ending").alias("ending"))


class Classes:
    """The bounded part of the model: frequent words by slot, classes and their leaves, and counts of both."""

    def __init__(self, slot, key, count, ending, n_total: int, n_words: int, follow: np.ndarray | None = None):
        size = 1 << SLOT_BITS
        self.key, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.of_slot = np.full(size, CLASSES - 1, np.uint8)
        self.leaf_of_slot = np.zeros(size, np.uint8)
        self.key[slot], self.count[slot] = key, count
        self.n_total, self.n_words = n_total, n_words
        order = np.lexsort((slot, -count))
        single, rest = order[:SINGLES], order[SINGLES:]
        self.of_slot[slot[single]] = np.arange(len(single))
        if len(rest):
            groups = group_endings(np.zeros((BUCKETS, BUCKETS)) if follow is None else follow, CLASSES - 1 - SINGLES)
            bucket = bucket_of_ending(ending[rest].astype(np.int64))
            cls = SINGLES + groups[bucket]
            by_class = np.argsort(cls, kind="stable")
            rank = np.empty(len(rest), np.int64)
            rank[by_class] = np.arange(len(rest)) - np.searchsorted(cls[by_class], cls[by_class])
            self.of_slot[slot[rest]] = cls
            self.leaf_of_slot[slot[rest]] = np.where(rank < OWN, rank, OWN + bucket % (LEAVES - OWN))
        in_class = np.bincount(self.of_slot[slot], count, minlength=CLASSES)
        self.tail_total, self.tail_words = n_total - int(in_class.sum()), n_words - len(slot)
        place = self.of_slot.astype(np.int64) * LEAVES + self.leaf_of_slot
        in_leaf = np.bincount(place[slot], count, minlength=CLASSES * LEAVES)
        with np.errstate(divide="ignore"):
            self.log_leaf = np.log(in_leaf.reshape(CLASSES, LEAVES) / np.maximum(in_class, 1)[:, None]).astype(np.float32)
        # log10 of the share of a frequent word in its leaf
        self.log_share = np.where(self.count > 0, np.log10(np.maximum(self.count, 1)) - np.log10(np.maximum(in_leaf, 1))[place], 0.0)
        self.log_tail = float(np.log10(self.tail_total + self.tail_words + 1))

    def look(self, h: np.ndarray):
        """Slot and class of each word, and whether it is its slot's frequent word."""
        slot = (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        known = (self.key[slot] == h) & (self.count[slot] > 0)
        return slot, known, np.where(known, self.of_slot[slot], CLASSES - 1).astype(np.int64)


def features(h: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature rows of each token's history, four a token; ``first`` marks the first token of a document."""
    h1, h2 = np.zeros_like(h), np.zeros_like(h)
    c1, c2 = np.full(len(h), CLASSES - 1), np.full(len(h), CLASSES - 1)
    h1[1:], c1[1:] = h[:-1], cls[:-1]
    h1[first], c1[first] = 1, CLASSES - 1
    h2[1:], c2[1:] = h1[:-1], c1[:-1]
    h2[first], c2[first] = 1, CLASSES - 1
    top = np.uint64(64 - (ROWS.bit_length() - 1))
    return np.stack([(h1 * _P) >> top, ((h1 * _Q + h2 * _P + np.uint64(1)) * _Q >> top) + np.uint64(ROWS), ((h2 ^ _Q) * _P >> top) + np.uint64(2 * ROWS), (c1 * CLASSES + c2 + 3 * ROWS).astype(np.uint64)]).astype(np.int64)


def has_leaves(cls: np.ndarray) -> np.ndarray:
    return (cls >= SINGLES) & (cls < CLASSES - 1)


def leaf_features(f: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Feature rows that predict the leaf inside ``cls``: the history's rows ``f``, but for the previous two words, joined with the class."""
    top = np.uint64(64 - (ROWS.bit_length() - 1))
    joined = (f[[0, 2, 3]].astype(np.uint64) * np.uint64(CLASSES) + cls.astype(np.uint64) + np.uint64(1)) * _P
    return ((joined ^ joined >> np.uint64(29)) * _Q >> top).astype(np.int64) + N_FEATURES + np.arange(3)[:, None] * ROWS


def sums_of_weights(w: np.ndarray, f: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
    z = np.take(w, f[0], axis=0)
    for k in f[1:]:
        z += np.take(w, k, axis=0)
    if prior is not None:
        z += prior
    return z


def row_max(z: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(z.T).max(axis=0)[:, None]  # faster than along short rows


def exp_lines(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp(z - m), its sum along each line, m): m are the maxima of lines where float32 could leave its range, else 0."""
    ones = np.ones(z.shape[1], z.dtype)
    if z.max(initial=0) < 60:  # no sum overflows
        e = np.exp(z)
        total = e @ ones
        if total.min(initial=1) > 1e-20:
            return e, total, 0.0
    m = row_max(z)
    e = np.exp(z - m)
    return e, e @ ones, m[:, 0]


def log_softmax(w: np.ndarray, f: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of all classes, or of all leaves of a class by their log shares ``prior``."""
    z = sums_of_weights(w, f, prior)
    z -= row_max(z)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def log_chosen(w: np.ndarray, f: np.ndarray, chosen: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """``log_softmax`` at one column of each line."""
    z = sums_of_weights(w, f, prior)
    _, total, m = exp_lines(z)
    return z[np.arange(len(z)), chosen].astype(np.float64) - m - np.log(total)


def log_places(w: np.ndarray, classes: Classes, f: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Log probability of each token's class and of its leaf in it."""
    lp = log_chosen(w, f, cls)
    at = np.flatnonzero(has_leaves(cls))
    lp[at] += log_chosen(w, leaf_features(f[:, at], cls[at]), leaf[at], classes.log_leaf[cls[at]])
    return lp


def summed(g: np.ndarray, row: np.ndarray, layers: int = 16):
    """(u, n, s): the distinct rows, how often each occurs, and the sums of their lines of ``g``.

    ``row`` gives rows of every line for one feature after the other; features share no rows.  The first
    lines of all rows are added layer by layer, those left of the few rows with more by a product with zeros and ones.
    """
    order = np.argsort(row.astype(ROW_TYPE), kind="stable")
    r, line = row[order], order % len(g)
    start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    n = np.diff(start, append=len(r))
    longest = np.argsort((len(g) - n).astype(np.min_scalar_type(len(g))), kind="stable")
    start, n = start[longest], n[longest]
    more = np.searchsorted(-n, -np.arange(layers + 1), side="left")  # rows with more than d lines
    s = np.take(g, line[start], axis=0)
    for d in range(1, layers):
        s[: more[d]] += np.take(g, line[start[: more[d]] + d], axis=0)
    if k := more[layers]:
        left = n[:k] - layers
        of, first = np.repeat(np.arange(k), left), np.cumsum(left) - left
        hot = np.zeros((k, len(g)), g.dtype)
        hot[of, line[(start[:k] + layers - first)[of] + np.arange(len(of))]] = 1
        s[:k] += hot @ g
    return r[start], n, s


def local_steps(w: np.ndarray, seen: np.ndarray, squares: np.ndarray, f: np.ndarray, cls: np.ndarray, prior: np.ndarray | None = None, rate: float = 0.15) -> None:
    """One stochastic (Adagrad) step on a batch of tokens."""
    g, total, _ = exp_lines(sums_of_weights(w, f, prior))
    g /= total[:, None]
    g[np.arange(len(cls)), cls] -= 1
    rows, times, sums = summed(g, f.ravel())
    seen[rows] += times
    for i in range(0, len(rows), CACHED):
        u, s = rows[i : i + CACHED], sums[i : i + CACHED]
        s /= np.sqrt(times[i : i + CACHED].astype(np.float32))[:, None]
        q = np.take(squares, u, axis=0)
        q += s * s
        squares[u] = q
        q += np.float32(1e-2)
        s *= np.float32(rate)
        s /= np.sqrt(q, out=q)
        w[u] = np.subtract(np.take(w, u, axis=0), s, out=q)


def _documents(batches, classes: Classes, wanted, size: int = 60_000):
    """Groups of documents as (ids, hashes, first positions)."""
    ids, hs, n = [], [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            if wanted(i):
                h = word_hashes(tokens(text.as_py()))
                ids.append(i)
                hs.append(h)
                n += len(h)
                if n >= size:
                    yield ids, hs
                    ids, hs, n = [], [], 0
    if ids:
        yield ids, hs


def train(docs: DataFrame, classes: Classes, holdout, id_col: str, text_col: str, rounds: int = ROUNDS, batch: int = 2048) -> np.ndarray:
    import pyarrow as pa

    spark = docs.sparkSession
    w = np.zeros((N_ROWS, CLASSES), np.float32)
    known = spark.sparkContext.broadcast(classes)
    for r in range(rounds):
        now = spark.sparkContext.broadcast(w)  # N_ROWS x CLASSES numbers

        # a task sends its updates once, however many input partitions it reads
        parts = docs.rdd.getNumPartitions()
        tasks = max(1, min(parts, 4 * spark.sparkContext.defaultParallelism), -(-parts // 8))

        def update(batches, r=r, now=now):
            c, w0 = known.value, now.value
            w, seen, squares = w0.copy(), np.zeros(len(w0), np.float32), np.zeros_like(w0)
            share = lambda i: _is_training(i, *holdout) and (zlib.crc32(str(i).encode()) >> 9) % rounds == r
            some, part = False, 0
            for ids, hs in _documents(batches, c, share):
                if not some:
                    some, part = True, zlib.crc32(str(ids[0]).encode())
                h = np.concatenate(hs)
                first = np.cumsum([0, *map(len, hs[:-1])])
                slot, _, cls = c.look(h)
                f = features(h, cls, first)
                for i in range(0, len(h), batch):
                    local_steps(w, seen, squares, f[:, i : i + batch], cls[i : i + batch])
                at = np.flatnonzero(has_leaves(cls))
                f, cls, leaf = leaf_features(f[:, at], cls[at]), cls[at], c.leaf_of_slot[slot[at]]
                for i in range(0, len(at), batch):
                    local_steps(w, seen, squares, f[:, i : i + batch], leaf[i : i + batch], c.log_leaf[cls[i : i + batch]])
            if some:
                delta = np.concatenate([(w - w0) * seen[:, None], seen[:, None]], axis=1).astype(np.float32)
                yield messages(((i // PIECE) * SALTS + part % SALTS, delta[i : i + PIECE]) for i in range(0, len(delta), PIECE))

        def messages(pieces):
            out = [(p, np.flatnonzero(d[:, -1]).astype(np.uint8), d) for p, d in pieces if d[:, -1].any()]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.int64()), pa.array([u.tobytes() for _, u, _ in out], pa.binary()), pa.array([d[u].tobytes() for _, u, d in out], pa.binary())], ["piece", "used", "sums"])

        def add(batches, shift):
            out = []
            for t in blocks(batches, "piece"):
                total = np.zeros((PIECE, CLASSES + 1), np.float32)
                for u, x in zip(t.column("used"), t.column("sums")):
                    total[np.frombuffer(u.as_py(), np.uint8)] += np.frombuffer(x.as_py(), np.float32).reshape(-1, CLASSES + 1)
                out.append((t.column("piece")[0].as_py() // shift, total))
            yield messages(out)

        schema = "piece long, used binary, sums binary"
        sums = docs.select(id_col, text_col).coalesce(tasks).mapInArrow(update, schema)
        for shift in (SALTS, 1):  # tasks' sums meet in SALTS groups of each piece, then once more
            sums = sums.repartition("piece").sortWithinPartitions("piece").mapInArrow(lambda b, shift=shift: add(b, shift), schema)
        w = w.copy()
        for row in sums.toArrow().to_pylist():  # as large as the weights
            d = np.frombuffer(row["sums"], np.float32).reshape(-1, CLASSES + 1)
            w[row["piece"] * PIECE + np.frombuffer(row["used"], np.uint8).astype(np.int64)] += d[:, :-1] / d[:, -1:]
        now.unpersist()
    return w


def score(docs: DataFrame, counts: DataFrame, classes: Classes, w: np.ndarray, holdout, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((classes, w))

    def work(batches):
        import pyarrow as pa

        c, w = shared.value
        for ids, hs in _documents(batches, c, lambda i: True):
            h = np.concatenate(hs)
            n = np.array([len(x) for x in hs])
            first = np.cumsum(n) - n
            slot, known, cls = c.look(h)
            f = features(h, cls, first)
            lp = np.empty(len(h))
            for i in range(0, len(h), 4096):
                some = slice(i, i + 4096)
                lp[some] = log_places(w, c, f[:, some], cls[some], c.leaf_of_slot[slot[some]])
            lp = lp / np.log(10) + np.where(known, c.log_share[slot], 0.0)
            base = np.where(known, np.log10(np.maximum(c.count[slot], 0) + 1.0), 0.0)
            by = lambda x: np.add.reduceat(x.astype(np.float64), first)
            n_known = by(known).astype(np.int64)
            tails = [np.unique(x[~k], return_counts=True) for x, k in zip(hs, np.split(known, first[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(n_known), pa.array(by(lp)), pa.array(by(base)), pa.array([t[0].view(np.int64) for t in tails], pa.list_(pa.int64())), pa.array([t[1].astype(np.int32) for t in tails], pa.list_(pa.int32()))],
                ["id", "n_tokens", "n_frequent", "lp", "base", "tail", "times"],
            )

    schema = "id long, n_tokens long, n_frequent long, lp double, base double, tail array<long>, times array<int>"
    rows = written(docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.times").alias("times"))
    # a common word may have lost its slot to a more common one
    found = with_groups(rare, counts.filter("not pair").select("h", "c", F.col("c").alias("n")), ["h"], "n").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    n_all, v = classes.n_total, classes.n_words
    rest, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    unit = float(np.log10(n_all + v + 1))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        (crc_remainder(F.col("id"), holdout[0]) == holdout[1]).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + rest).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("lp") + logs - (F.col("n_tokens") - F.col("n_frequent")) * classes.log_tail).alias("score"),
    )


def classes_of(counts: DataFrame) -> Classes:
    follow = np.zeros(BUCKETS * BUCKETS)
    for r in counts.filter("pair").select("h", "c").collect():  # at most BUCKETS x BUCKETS rows
        follow[r["h"]] = r["c"]
    counts = counts.filter("not pair")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    slot = F.col("h").bitwiseAND((1 << SLOT_BITS) - 1)
    heads = counts.groupBy(slot.alias("slot")).agg(F.max(F.struct("c", "h", "ending")).alias("m")).select("slot", "m.c", "m.h", "m.ending").toArrow()  # at most 2^SLOT_BITS rows
    col = lambda n, kind: heads.column(n).to_numpy().astype(kind)
    return Classes(col("slot", np.int64), col("h", np.int64).view(np.uint64), col("c", np.int64), col("ending", np.int64), int(total["n"]), int(total["v"]), follow.reshape(BUCKETS, BUCKETS))


def lm_scores(docs: DataFrame, holdout: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each document.

    Documents whose crc32(id as text) modulo n equals k, of ``holdout`` = (n, k), are not learnt from.
    """
    counts = written(word_counts(docs, holdout, id_col, text_col), "word-counts")
    classes = classes_of(counts)
    w = train(docs, classes, holdout, id_col, text_col)
    return score(docs, counts, classes, w, holdout, id_col, text_col)

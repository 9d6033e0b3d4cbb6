"""Near-duplicate detection: a chosen-path set similarity join on word shingles.

1.  Every text gets its distinct shingles (64-bit hashes of five words), a minhash signature and a
    digest of its words.  Texts with the same words form one class, and only classes go on.
2.  In each of several independent trees (each with coordinates of its own) a class descends along
    the minwise tokens that its node selects, two of them on the first levels and one on later ones.
    Nodes of one class end; small nodes are compared exhaustively on signatures; large ones go on to
    the last level, where those that are still large become one cluster as they are.  Pairs whose
    signatures agree far below the threshold (five standard deviations) are left out.
3.  Links are confirmed on full shingle sets inside each cluster.  A cluster larger than a block is
    dealt in blocks, compared inside them and then with the blocks' most central members.  Where
    that leaves few classes outside a cluster's main component, these meet all its blocks; where it
    leaves many, the cluster's classes descend again, in trees whose hash functions are drawn anew at
    every node, until nodes are small or nearly of one component; nodes that stay large are compared
    block by block, so the rest has an exact way.
4.  Components of the confirmed links give each document its class.

The number of trees follows from the recall that is aimed at: ``missed`` is the probability that a
pair at the threshold parts on every path of one tree.

Defined cases: null and empty texts (or white space alone) have no shingles and are linked with
nothing; with fewer than five words the whole sequence is the one shingle; repeated rows are copies,
also under a repeated id, and different texts may share one; a null id keeps component null and
``kept`` true; ids of any type that has an order will do; very long texts count whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, with_groups, written
from .graph import components

#: Branches of each level: while candidates are sought, and inside clusters that stay unconnected.
SEEK, DEEP = (2, 2, 1, 1), (2, 2, *[1.3] * 10)
RECALL, DEEP_RECALL = 0.9999, 0.999
WIDTH = 4  # coordinates of each level of a tree
NODE = 64  # classes in a node that is compared exhaustively
BLOCK = 256
_P = np.uint64(0x9E3779B97F4A7C15)


def missed(similarity: float, branches) -> float:
    """The probability that a pair shares no node of a tree's last level: a branching process dies out."""
    q = 0.0
    for b in reversed(branches):
        u = 1 - similarity + similarity * q
        q = (1 - b % 1) * u ** int(b) + (b % 1) * u ** (int(b) + 1)
    return q


def trees_for(recall: float, similarity: float, branches) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, missed(similarity, branches)))))


def least_agreement(coordinates: int, similarity: float) -> int:
    """Five standard deviations below what a pair at the threshold shares."""
    return int(coordinates * similarity - 5 * (coordinates * similarity * (1 - similarity)) ** 0.5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; of the whole sequence if it is shorter."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = x * _P + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(x))


def hash_family(t: int, seed: int = 20240501):
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, t, dtype=np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum over the set of each hash a x + b."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        y = s[i : i + 1024, None] * a
        y += b
        np.minimum(best, y.min(axis=0), out=best)
    return best


def signature(s: np.ndarray, family) -> np.ndarray:
    return (minima(s, *family) >> np.uint64(48)).astype(np.uint16)


def _keys(words: list[bytes]) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def row_key(text_col: str):
    """What tells apart the texts that share an id."""
    return F.xxhash64(F.col(text_col), F.col(text_col).isNull())


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, coordinates: int) -> DataFrame:
    """(doc, key, n_shingles, k1, k2, sig) for every row; nulls in the last three where there is no word."""

    def work(batches):
        import pyarrow as pa

        family = hash_family(coordinates)
        for b in batches:
            rows = []
            for text in b.column(1):
                w = words_of(text.as_py())
                s = shingles(w, n)
                rows.append((len(s), *_keys(w), signature(s, family).tobytes()) if w else (0, None, None, None))
            c = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], ["doc", "key", "n_shingles", "k1", "k2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), row_key(text_col).alias("key")).mapInArrow(work, f"doc {kind}, key long, n_shingles long, k1 long, k2 long, sig binary")


def _child(node: np.ndarray, sig: np.ndarray, level: int, branch: int) -> np.ndarray:
    """The child of each class's node along one of the minwise tokens that the node selects; the low byte is the tree."""
    tree, h = node & np.uint64(255), _mix(node)
    at = (h + np.uint64(branch) * (np.uint64(1) + (h >> np.uint64(20)) % np.uint64(WIDTH - 1))) % np.uint64(WIDTH)
    c = (tree * np.uint64(len(SEEK) * WIDTH) + np.uint64(level * WIDTH) + at).astype(np.int64)
    token = sig[np.arange(len(sig)), c].astype(np.uint64)
    return _mix(node * _P + _mix(token + np.uint64(0x1F0A2BE71D163FA0) * (c + 1).astype(np.uint64))) << np.uint64(8) | tree


def paths(reps: DataFrame, trees: int) -> DataFrame:
    """(node, last, id): the nodes of each class after the levels with two branches, and where each leads on the last level."""
    width = trees * len(SEEK) * WIDTH

    def work(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            ids, sig = b.column(0), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, width)
            for t in range(trees):
                level = [np.full(len(sig), t, np.uint64)]
                for k in (0, 1):
                    level = [_child(x, sig, k, branch) for x in level for branch in range(SEEK[k])]
                for x in level:
                    last = _child(_child(x, sig, 2, 0), sig, 3, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(last.view(np.int64)), ids], ["node", "last", "id"])

    return reps.select("id", "sig").mapInArrow(work, "node long, last long, id long")


class _Sets:
    """Union-find over positions."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _agreement(sig: np.ndarray) -> np.ndarray:
    same = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(sig.shape[1]):
        same += sig[:, k, None] == sig[None, :, k]
    return same


def _pairs(rows: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["a", "b"])


def node_edges(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) tying the classes of each block (columns block, id, sig) whose signatures agree in ``least`` coordinates."""

    def work(batches):
        out: list = []
        for t in blocks(batches, "block"):
            ids = t.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            sets = _Sets(len(ids))
            for i in range(len(ids) - 1):
                for j in (np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least) + i + 1).tolist():
                    if sets.join(i, j):
                        out.append((int(ids[i]), int(ids[j])))
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.repartition("block").sortWithinPartitions("block").select("block", "id", "sig").mapInArrow(work, "a long, b long")


def clusters(reps: DataFrame, least: int, trees: int) -> DataFrame:
    """(id, root): classes tied by the trees; classes alone are left out."""
    size_of = lambda rows, key: written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("head")).filter("size > 1"), "sizes")
    rows = written(paths(reps, trees), "paths")
    held = written(with_groups(rows, size_of(rows, "node"), ["node"], "size"), "nodes")
    large = held.filter(f"size > {NODE}").select("last", "id")
    nodes = held.filter(f"size <= {NODE}").select(F.col("node").alias("block"), "id")
    whole = None
    if not large.isEmpty():
        held = written(with_groups(large, size_of(large, "last"), ["last"], "size"), "nodes")
        nodes = nodes.unionByName(held.filter(f"size <= {BLOCK}").select(F.col("last").alias("block"), "id"))
        whole = held.filter(f"size > {BLOCK}").select(F.col("id").alias("a"), F.col("head").alias("b"))
    tied = node_edges(nodes.join(reps.select("id", "sig"), "id"), least)
    return components(tied if whole is None else tied.unionByName(whole))


def verified_links(rows: DataFrame, percent: int, coordinates: int = 64) -> DataFrame:
    """Links (a, b) confirmed on full sets inside each block of (block, id, comp, guest, shingles).

    Classes of equal ``comp`` are connected already.  In a block with guests, these are compared with
    its members, and nothing else is.  Only links that connect are returned, and for each block the
    member that agrees most with the others, marked by a = b.
    """
    least = least_agreement(coordinates, percent / 100)

    def work(batches):
        import pyarrow as pa

        family = hash_family(coordinates)
        for t in blocks(batches, "block"):
            # a class may be member and guest of a block at once: the member's row stays
            order = np.argsort(t.column("guest").to_numpy(zero_copy_only=False), kind="stable")
            ids, first = np.unique(t.column("id").to_numpy()[order], return_index=True)
            if len(ids) < 2:
                continue
            t = t.take(pa.array(order[first]))
            sets_ = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            guest, comp = t.column("guest").to_numpy(zero_copy_only=False), t.column("comp").to_pylist()
            n = np.array([len(s) for s in sets_])
            same = _agreement(np.stack([signature(s, family) for s in sets_]))
            uf, seen, out = _Sets(len(ids)), {}, []
            for i, c in enumerate(comp):
                if c is not None:
                    uf.join(seen.setdefault(c, i), i)
            possible = (same >= least) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
            if guest.any():
                possible &= guest[:, None] != guest
            i, j = np.nonzero(np.triu(possible, 1))
            for k in np.argsort(-same[i, j].astype(np.int16), kind="stable"):
                a, b = int(i[k]), int(j[k])
                if uf.root(a) == uf.root(b):
                    continue
                both = len(np.intersect1d(sets_[a], sets_[b], assume_unique=True))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    uf.join(a, b)
                    out.append((int(ids[a]), int(ids[b])))
            m = int(ids[int(np.argmax(np.where(guest, -1, same.sum(axis=1, dtype=np.int64))))])
            yield _pairs([*out, (m, m)])

    return rows.select("block", "id", "comp", "guest", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(work, "a long, b long")


def _branches_of(node: np.ndarray, mean: float) -> np.ndarray:
    """How many tokens each node selects: the mean's whole part, and one more with its fraction."""
    return int(mean) + ((_mix(node) >> np.uint64(44)) < np.uint64(int(mean % 1 * (1 << 20)))).astype(np.int64)


def deeper(nodes: np.ndarray, s: np.ndarray, branches) -> np.ndarray:
    """The nodes that a set reaches from ``nodes`` over levels of the given branches; each node draws its own hash functions."""
    for mean in branches:
        n = _branches_of(nodes, mean)
        up = np.repeat(nodes, n)
        seed = _mix(up + _P * (np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64))
        nodes = _mix(seed * _P + minima(s, seed | np.uint64(1), _mix(seed ^ _P)))
    return nodes


def across(rows: DataFrame) -> DataFrame:
    """(block, id, comp, guest) from (node, id, comp, n, outside, main): what is outside a node's main component meets all its blocks, in chunks."""
    put = rows.withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("chunks", F.ceil(F.col("outside") / BLOCK))
    home = F.xxhash64("node", "part", "chunk").alias("block")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    guests = put.filter("comp <> main").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), "chunks")).withColumn("part", upto("parts"))
    hosts = put.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("chunk", upto("chunks"))
    return guests.select(home, "id", "comp", F.lit(True).alias("guest")).unionByName(hosts.select(home, "id", "comp", F.lit(False).alias("guest")))


def mixed(rows: DataFrame) -> DataFrame:
    """Those (node, id, comp) whose node holds several components, with its size n, its main component and how many are outside that."""
    by = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("m"))
    nodes = by.select("node", "n", F.col("m.comp").alias("main"), (F.col("n") - F.col("m.c")).alias("outside")).filter("outside > 0")
    return written(with_groups(rows, written(nodes, "mixed"), ["node"], "n"), "deep-nodes")


def scattered_links(members: DataFrame, links: DataFrame, percent: int) -> DataFrame | None:
    """Links that the large clusters' blocks missed; ``members`` is (id, cluster, shingles), ``links`` those found.  None if there is nothing to do.

    A cluster or node with few classes outside its main component is compared block by block, which
    costs rows in proportion to its size; one with many descends.
    """
    now = mixed(members.select(F.col("cluster").alias("node"), "id").distinct().join(components(links), "id", "left").select("node", "id", F.coalesce("root", "id").alias("comp")))
    if now.isEmpty():
        return None
    trees = trees_for(DEEP_RECALL, percent / 100, DEEP)
    fresh = 160  # coordinates, of one byte each, for comparing inside small nodes
    least = least_agreement(fresh, percent / 100)
    few = (F.col("outside") <= BLOCK) & (F.col("n") > 2 * NODE)

    def sketch(batches):
        import pyarrow as pa

        family = hash_family(fresh, 7)
        for b in batches:
            sig = [(minima(np.frombuffer(x, np.uint64), *family) >> np.uint64(56)).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.binary())], ["id", "shingles", "sig"])

    def descend(levels):
        def work(batches):
            import pyarrow as pa

            for b in batches:
                for i, c, nodes, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    x = np.unique(deeper(np.array(nodes, np.int64).view(np.uint64), np.frombuffer(s, np.uint64), levels))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.full(len(x), i)), pa.array(np.full(len(x), c))], ["node", "id", "comp"])

        return work

    def near(batches):
        import pyarrow as pa

        for t in blocks(batches, "block"):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), -1)
            comp = t.column("comp").to_numpy()
            at = np.flatnonzero(((_agreement(sig) >= least) & (comp[:, None] != comp)).any(axis=1))
            if len(at):
                yield from t.select(["block", "id", "comp"]).take(pa.array(at)).to_batches()

    open_ = now.select("id").distinct()
    sets = written(members.select("id", "shingles").dropDuplicates(["id"]).join(open_, "id", "left_semi").mapInArrow(sketch, "id long, shingles binary, sig binary"), "open-sets")
    meet, small = [across(now.filter(few))], []
    large, seeds = now.filter(~few), F.array(*[F.xxhash64("node", F.lit(t)) for t in range(trees)])
    for k in range(0, len(DEEP), 3):
        if large.isEmpty():
            break
        # at most trees x the branches so far nodes a class
        at = large.select("id", "comp", seeds.alias("nodes")) if k == 0 else large.groupBy("id", "comp").agg(F.collect_list("node").alias("nodes"))
        rows = at.join(sets.select("id", "shingles"), "id").select("id", "comp", "nodes", "shingles").mapInArrow(descend(DEEP[k : k + 3]), "node long, id long, comp long")
        now = mixed(written(rows, "deep-paths"))
        meet.append(across(now.filter(few)))
        small.append(now.filter(F.col("n") <= 2 * NODE).select(F.col("node").alias("block"), "id", "comp"))
        large = now.filter(~few & (F.col("n") > 2 * NODE))
    meet.append(across(large))  # nodes that no descent makes small
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    wanted = union(meet)
    if small:
        near_rows = union(small).join(sets.select("id", "sig"), "id").select("block", "id", "comp", "sig").repartition("block").sortWithinPartitions("block").mapInArrow(near, "block long, id long, comp long")
        wanted = wanted.unionByName(near_rows.select("block", "id", "comp", F.lit(False).alias("guest")))
    return verified_links(wanted.join(sets.select("id", "shingles"), "id"), percent, fresh).filter("a <> b")


def confirm(docs: DataFrame, reps: DataFrame, tied: DataFrame, id_col: str, text_col: str, percent: int, n: int, repeated: bool) -> DataFrame:
    """All links needed to connect each cluster's classes, confirmed on full shingle sets; ``repeated``: rows may be equal in id and text."""

    def sets_of(batches):
        import pyarrow as pa

        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                keep, sets_ = [], []
                for i, (text, k1, k2) in enumerate(zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())):
                    w = words_of(text.as_py())
                    if _keys(w) == (k1, k2):
                        keep.append(i)
                        sets_.append(shingles(w, n).tobytes())
                t = pa.Table.from_batches([b]).select(["k1", "cluster", "size"]).take(pa.array(keep, pa.int64()))
                yield from pa.table({"id": t.column("k1"), "cluster": t.column("cluster"), "size": t.column("size"), "shingles": pa.array(sets_, pa.binary())}).to_batches()

    whole = tied.unionByName(tied.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "cluster")
    sizes = written(whole.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster-sizes")
    wanted = with_groups(whole, sizes, ["cluster"], "size").join(reps.select("id", "k2", "least"), "id")
    # each class by one row: ids alone may be those of many texts
    texts = docs.select(F.col(id_col).alias("_doc"), row_key(text_col).alias("_key"), F.col(text_col).alias("text")).join(wanted, (F.col("_doc") == F.col("least.doc")) & (F.col("_key") == F.col("least.key")))
    if repeated:
        texts = texts.dropDuplicates(["id"])
    members = written(texts.select("text", F.col("id").alias("k1"), "k2", "cluster", "size").mapInArrow(sets_of, "id long, cluster long, size long, shingles binary"), "shingles")
    parts = F.ceil(F.col("size") / BLOCK)
    dealt = members.withColumn("part", F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("id"), parts)).otherwise(F.lit(0)))
    home, none, no = F.xxhash64("cluster", "part").alias("block"), F.lit(None).cast("long").alias("comp"), F.lit(False).alias("guest")
    found = written(verified_links(dealt.select(home, "id", none, no, "shingles"), percent), "links")
    links = found.filter("a <> b")
    if sizes.filter(f"size > {BLOCK}").isEmpty():
        return links
    big = dealt.filter(F.col("size") > BLOCK)
    # against the most central member of each block, at most 16 a cluster
    central = big.join(found.filter("a = b").select(F.col("a").alias("id")).distinct(), "id", "left_semi").filter("part < 16")
    guests = central.select("cluster", "id", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    star = big.select(home, "id", none, no, "shingles").unionByName(guests.select(home, "id", none, F.lit(True).alias("guest"), "shingles"))
    links = written(links.unionByName(verified_links(star, percent).filter("a <> b")), "links")
    more = scattered_links(big, links, percent)
    return links if more is None else links.unionByName(more)


def _classified(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, key, n_shingles, least), one row for each document: ``least`` is the smallest (doc, key) of its component; and whether rows repeat in (doc, key)."""
    trees = trees_for(RECALL, percent / 100, SEEK)
    coordinates = trees * len(SEEK) * WIDTH
    sk = written(sketches(docs, id_col, text_col, shingle, coordinates), "sketches")
    repeated = not sk.filter("doc is not null").groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    linked = F.col("k1").isNotNull() & F.col("doc").isNotNull()
    own = F.struct("doc", "key")
    classes = sk.filter(linked).groupBy("k1", "k2").agg(F.min(own).alias("least"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    reps = written(classes.withColumnRenamed("k1", "id"), "classes")
    tied = clusters(reps, least_agreement(coordinates, percent / 100), trees)
    roots = components(confirm(docs, reps, tied, id_col, text_col, percent, shingle, repeated))
    # a component is named by its smallest document
    linked_reps = reps.select("id", "least").join(roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()), "id")
    names = written(linked_reps.groupBy("root").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("n")), "component-names")
    of = with_groups(linked_reps.select("id", "root"), names, ["root"], "n").select("id", "name")
    named = written(reps.select("id", "k2", "least", "n").join(of, "id", "left").select(F.col("id").alias("k1"), "k2", "n", F.coalesce("name", "least").alias("least")), "named-classes")
    hit = with_groups(sk.filter(linked).select("doc", "key", "n_shingles", "k1", "k2"), named, ["k1", "k2"], "n")
    alone = sk.filter(~linked).select("doc", "key", "n_shingles", own.alias("least"))
    return hit.select("doc", "key", "n_shingles", "least").unionByName(alone), repeated


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each document; links need 100 |A and B| >= percent |A or B|."""
    out, _ = _classified(docs, percent, shingle, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.col("least.doc").alias("component_id"), F.coalesce(F.col("doc") == F.col("least.doc"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate class: the one with the smallest id, and of texts under that id one; all columns stay.

    Documents with a null id stay, and so do those without words; of rows equal in id and text one stays.
    """
    rows, repeated = _classified(docs, percent, shingle, id_col, text_col)
    ids = rows.filter((F.col("doc") == F.col("least.doc")) & (F.col("key") == F.col("least.key"))).select(F.col("doc").alias("_kept_id"), F.col("key").alias("_kept_key"))
    own = docs.filter(F.col(id_col).isNotNull())
    stay = own.join(ids, (own[id_col] == F.col("_kept_id")) & (row_key(text_col) == F.col("_kept_key")), "left_semi")
    if repeated:
        stay = stay.dropDuplicates([id_col, text_col])
    return docs.filter(F.col(id_col).isNull()).unionByName(stay)

"""External induced sorting of one shard's suffixes, with their common-prefix values.

Symbols are integers; a suffix is S if it is smaller than its successor, else L.  The leftmost S
suffixes of each run (S*) are sorted first: their substrings by an induction from unsorted seeds, then,
where two are equal, the string of their names by the same procedure (recursion).  From them one scan
upwards induces all L suffixes, and one scan downwards from these all S suffixes.

A scan takes tuples (symbol, position, common prefix with the tuple before) from a priority queue and
puts the tuple of the position before into it.  Keys never fall below what was taken, and tuples
of one symbol arrive in the order of their successors, so the queue keeps buckets of symbols and a
stable sort orders a bucket.  Tuples beyond ``memory`` lie in an unnamed spill file of the task.  A
common prefix of two neighbours of one symbol is one more than the least of the values scanned between their successors.

Values stop at ``cap``, which decides repeats of ``cap`` symbols exactly.  The work is array
operations over blocks of tuples; a run of one symbol takes a block for each of its positions.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 16
#: Tuples of a block where a bucket holds several symbols.
SMALL = 1 << 11
#: A string of names that fits in memory ends the recursion: it is sorted by doubling prefixes there.
BASE = 1 << 21
#: Tuples (24 bytes each) and entries of work arrays held in memory.
MEMORY = 1 << 21


def scratch(n: int, dtype, memory: int = MEMORY) -> np.ndarray:
    """A work array, beyond ``memory`` entries mapped from an unnamed spill file."""
    return np.empty(n, dtype) if n <= memory else np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class Queue:
    """A monotone priority queue of rows (key, position, common prefix) in buckets of keys, on disk beyond ``memory`` rows."""

    def __init__(self, bounds: np.ndarray, memory: int):
        self.bounds, self.memory = bounds, memory
        self.held: list[list] = [[] for _ in range(len(bounds) + 1)]
        self.spilled: list[list] = [[] for _ in range(len(bounds) + 1)]
        self.n, self.file, self.end = 0, None, 0

    def push(self, rows: np.ndarray) -> None:
        at = np.searchsorted(self.bounds, rows[:, 0], "right").astype(np.uint16)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.held[at[a]].append(rows[a:b])
        self.n += len(rows)
        if self.n > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        for kept, gone in zip(self.held, self.spilled):
            if kept:
                rows = np.concatenate(kept)
                self.file.write(rows.tobytes())
                gone.append((self.end, len(rows)))
                self.end += rows.nbytes
                kept.clear()
        self.n = 0

    def pop(self, bucket: int) -> np.ndarray | None:
        """The bucket's oldest rows, or None."""
        if self.spilled[bucket]:
            at, n = self.spilled[bucket].pop(0)
            self.file.seek(at)
            return np.frombuffer(self.file.read(24 * n), np.int64).reshape(n, 3)
        if self.held[bucket]:
            rows = np.concatenate(self.held[bucket])
            self.held[bucket].clear()
            self.n -= len(rows)
            return rows
        return None


class Least:
    """Least value between two points of a growing sequence of values up to a small cap."""

    def __init__(self):
        self.at, self.value, self.n = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def since(self, first: np.ndarray) -> np.ndarray:
        """Least of the values from ``first`` to the end; a large number where there is none."""
        k = np.searchsorted(self.at, first)
        return np.append(self.value, 1 << 40)[k]

    def extend(self, v: np.ndarray) -> None:
        after = np.append(np.minimum.accumulate(v[::-1])[::-1][1:], 1 << 40)
        new = np.flatnonzero(v < after)
        old = self.value < v.min()
        self.at, self.value = np.append(self.at[old], self.n + new), np.append(self.value[old], v[new])
        self.n += len(v)


def least_between(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(v[a..b]) for each pair, a <= b."""
    width = b - a + 1
    level = np.frexp(width)[1] - 1
    out, step = np.empty(len(a), v.dtype), v
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            step = np.minimum(step[:-half], step[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(step[a[at]], step[b[at] - (1 << k) + 1])
    return out


def induce(key, target, run, seeds, seed_lcp, first, cap: int, memory: int, visit) -> None:
    """One scan in the order of ``key``: ``visit(positions, common prefixes, queued)`` for block after block.

    ``seeds`` come after the queue's tuples of their key; positions with ``target`` are put into the
    queue when their successor is scanned; ``first`` are rows that the queue starts with.
    """
    n_keys = int(key.max()) + 1
    narrow = np.uint16 if n_keys <= 1 << 16 else np.int64  # a radix sort for keys of 16 bits
    if single := n_keys <= 512:
        bounds = np.arange(1, n_keys)
    else:
        total = np.cumsum(np.bincount(key, minlength=n_keys))
        parts = min(1 << 15, max(64, 8 * len(key) // memory))
        bounds = np.unique(np.searchsorted(total, np.arange(1, parts) * (len(key) / parts)) + 1)
    queue, least, last = Queue(bounds, memory), Least(), np.full(n_keys, -1, np.int64)
    seed_key = key[seeds].astype(np.int64)
    ends = [0, *np.searchsorted(seed_key, bounds).tolist(), len(seeds)]
    before = [-1, 0]  # key and position of the last scanned
    if len(first):
        queue.push(first)

    def scan(rows, seed):
        k, pos, lcp = rows[:, 0], rows[:, 1], rows[:, 2].copy()
        if seed is True or (seed is not False and seed.any()):
            k0, p0 = np.append(before[0], k[:-1]), np.append(before[1], pos[:-1])
            was = np.append(before[2] if len(before) > 2 else False, np.broadcast_to(seed, len(k))[:-1])
            at = np.flatnonzero(np.broadcast_to(seed, len(k)) & ~was | (np.broadcast_to(seed, len(k)) & (k0 != k)))
            lcp[at] = np.where(k0[at] == k[at], np.minimum(np.minimum(run[p0[at]], run[pos[at]]), cap), 0)
        visit(pos, lcp, seed)
        before[:] = [int(k[-1]), int(pos[-1]), bool(seed if isinstance(seed, bool) else seed[-1])]
        prev = pos - 1
        t = np.flatnonzero((prev >= 0) & target[prev])
        r0, fresh = least.n, np.empty((len(t), 3), np.int64)
        if len(t):
            fresh[:, 0], fresh[:, 1] = key[prev[t]], prev[t]
            o = np.argsort(fresh[:, 0].astype(narrow), kind="stable")
            pk, ts = fresh[o, 0], t[o]
            head = np.append(True, pk[1:] != pk[:-1])
            value = np.empty(len(o), np.int64)
            h = np.flatnonzero(head)
            lows = np.minimum.accumulate(lcp)
            since = last[pk[h]]
            value[h] = np.where(since < 0, -1, np.minimum(least.since(since + 1), lows[ts[h]]))
            g = np.flatnonzero(~head)
            if len(g):
                value[g] = least_between(lcp, ts[g - 1] + 1, ts[g])
            fresh[o, 2] = np.minimum(value + 1, cap)
            tail = np.append(head[1:], True)
            last[pk[tail]] = r0 + ts[tail]
        least.extend(lcp)
        return fresh

    none = np.empty((0, 3), np.int64)
    for b in range(len(bounds) + 1):
        z0, z1 = ends[b], ends[b + 1]
        if single:
            while (rows := queue.pop(b)) is not None:
                for a in range(0, len(rows), BLOCK):
                    if len(fresh := scan(rows[a : a + BLOCK], False)):
                        queue.push(fresh)
            for a in range(z0, z1, BLOCK):
                e = min(z1, a + BLOCK)
                if len(fresh := scan(np.stack([seed_key[a:e], seeds[a:e], seed_lcp[a:e]], 1), True)):
                    queue.push(fresh)
            continue
        parts = []
        while (rows := queue.pop(b)) is not None:
            parts.append(rows)
        seeded = np.stack([seed_key[z0:z1], seeds[z0:z1], seed_lcp[z0:z1]], 1)
        rows = np.concatenate([none, *parts, seeded])
        rank = 2 * rows[:, 0] + (np.arange(len(rows)) >= len(rows) - len(seeded))
        order = np.argsort(rank, kind="stable")
        rows, rank = rows[order], rank[order]
        top = bounds[b] if b < len(bounds) else n_keys
        while len(rows):
            # a tuple waits for all tuples that those before it put in front of it
            part = rows[:SMALL]
            prev = np.maximum(part[:, 1] - 1, 0)
            puts = np.where((part[:, 1] > 0) & target[prev], 2 * key[prev].astype(np.int64), 1 << 40)
            free = rank[1 : len(part)] <= np.minimum.accumulate(puts)[:-1]
            m = len(part) if free.all() else int(np.argmin(free)) + 1
            fresh = scan(part[:m], (rank[:m] & 1).astype(bool))
            rows, rank = rows[m:], rank[m:]
            here = fresh[:, 0] < top
            if not here.all():
                queue.push(fresh[~here])
            if here.any():
                mine = fresh[here]
                mine = mine[np.argsort(mine[:, 0], kind="stable")]
                at = np.searchsorted(rank, 2 * mine[:, 0], "right")
                rows, rank = np.insert(rows, at, mine, 0), np.insert(rank, at, 2 * mine[:, 0])


def _both(text, s_type, run, seeds, seed_lcp, cap, memory, visit) -> None:
    """Upwards for the L suffixes, downwards for the S suffixes; ``visit`` sees all suffixes from the largest to the least."""
    n, n_l = len(text), int(len(text) - s_type.sum())
    up, lcp, filled = scratch(n_l, np.int64, memory), scratch(n_l, np.int64, memory), [0]

    def keep(pos, value, seed):
        mine = slice(None) if seed is False else np.flatnonzero(~np.broadcast_to(seed, len(pos)))
        pos, value = pos[mine], value[mine]
        up[filled[0] : filled[0] + len(pos)], lcp[filled[0] : filled[0] + len(pos)] = pos, value
        filled[0] += len(pos)

    induce(text, ~s_type, run, seeds, seed_lcp, np.empty((0, 3), np.int64), cap, memory, keep)
    top = int(text.max())
    down = np.subtract(top, text, out=scratch(n, text.dtype, memory))
    end = np.array([[top - int(text[-1]), n - 1, 0]])
    induce(down, s_type, run, up[::-1], np.append(0, lcp[:0:-1]), end, cap, memory, visit)


def _matched(text, a, b, most) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common, up to ``most`` of each pair."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(text)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        live = live[(out[live] < most[live]) & (i < n) & (j < n)]
        if len(live):
            live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
            out[live] += 1
    return out


def _doubling(text: np.ndarray, cap: int):
    """Suffix array of a string in memory, as far as ``cap`` symbols tell, and common prefixes up to ``cap``.

    The ranks of every doubled length are kept, so that a common prefix is found by halving lengths.
    """
    n, step = len(text), 1
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    while True:
        rank = ranks[-1]
        key = rank.astype(np.int64) * (n + 1)
        key[: max(n - step, 0)] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        step *= 2
        if new[-1] == n - 1 or step >= cap:
            break
        rank = np.empty(n, np.int32)
        rank[order] = new
        ranks.append(rank)
    a, b, lcp = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in reversed(range(len(ranks))):
        # a shorter rest ends in the only 0, so ranks of different lengths never agree there
        for _ in range(2 if k == len(ranks) - 1 else 1):
            i, j = a + lcp, b + lcp
            t = np.flatnonzero((i < n) & (j < n))
            t = t[ranks[k][i[t]] == ranks[k][j[t]]]
            lcp[t] += 1 << k
    return order, np.append(0, np.minimum(lcp, cap))


def sort_suffixes(text: np.ndarray, cap: int, visit, memory: int = MEMORY, base: int = BASE) -> None:
    """``visit(positions, common prefix with the suffix visited before)`` for all suffixes, the largest first.

    ``text``: integers from 0, of which 0 stands at the end only.
    """
    n = len(text)
    if n == 1:
        visit(np.zeros(1, np.int64), np.zeros(1, np.int64))
        return
    edge = np.flatnonzero(text[1:] != text[:-1]) + 1
    starts, ends = np.append(0, edge), np.append(edge, n)
    run = scratch(n, np.int32, memory)
    np.subtract(np.repeat(ends, ends - starts), np.arange(n), out=run, casting="unsafe")
    rises = np.append(text[np.minimum(ends[:-1], n - 1)] > text[starts[:-1]], True)  # of each run: what follows is larger
    s_type = np.repeat(rises, ends - starts)
    star = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1  # in text order, the end last
    m = len(star)
    got: list = []

    def stars(pos, value, seed):
        mine = pos[s_type[pos] & (pos > 0) & ~s_type[pos - 1]]
        if len(mine):
            got.append(mine[::-1])

    first = star[np.argsort(text[star], kind="stable")]
    _both(text, s_type, run, first, np.zeros(m, np.int64), cap, memory, stars)
    order = np.concatenate(got[::-1])
    span = np.append(np.diff(star), 0) + 1
    index = scratch(n, np.int64, memory)
    index[star] = np.arange(m)
    by = index[order]
    la, lb = span[by[:-1]], span[by[1:]]
    same = la == lb
    at = np.flatnonzero(same)
    same[at] = _matched(text, order[at], order[at + 1], la[at]) == la[at]
    name = np.append(0, np.cumsum(~same))
    if name[-1] == m - 1:
        ranked, symbols = by, np.zeros(m, np.int64)
    else:
        names = np.empty(m, np.int32)
        names[by] = name
    if name[-1] < m - 1 and m <= base:
        ranked, symbols = _doubling(names, cap // 2 + 1)
    elif name[-1] < m - 1:
        found: list = []
        sort_suffixes(names, cap // 2 + 1, lambda pos, value: found.append((pos.copy(), value.copy())), memory, base)
        ranked = np.concatenate([f[0] for f in found])[::-1]
        symbols = np.append(0, np.concatenate([f[1] for f in found])[:0:-1])
    # common prefixes of S* neighbours: whole common names, then what the first differing ones share
    lcp = np.zeros(m, np.int64)
    a, b, l = ranked[:-1], ranked[1:], symbols[1:]
    whole = star[np.minimum(a + l, m - 1)] - star[a]
    more = _matched(text, star[np.minimum(a + l, m - 1)], star[np.minimum(b + l, m - 1)], np.maximum(cap - whole, 0))
    lcp[1:] = np.minimum(whole + more, cap)
    _both(text, s_type, run, star[ranked], lcp, cap, memory, lambda pos, value, seed: visit(pos, value))


def repeated(text: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """For each position of ``text`` (0 at the end only), whether its ``length`` symbols also start at another position."""
    twice, before = np.zeros(len(text), bool), [0]

    def mark(pos, lcp):
        t = np.flatnonzero(lcp >= length)
        twice[pos[t]] = True
        twice[np.append(before[0], pos[:-1])[t]] = True
        before[0] = pos[-1]

    sort_suffixes(text, length, mark, memory)
    return twice

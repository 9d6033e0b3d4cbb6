"""External induced sorting and the removal of repeated passages, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meshspark.llm import induced, repeats


def brute_suffixes(text, cap):
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])

    def common(a, b):
        k = 0
        while k < cap and max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        return k

    return order, [0] + [common(order[i - 1], order[i]) for i in range(1, n)]


def strings():
    rng = np.random.default_rng(0)
    yield []
    yield [1] * 50
    yield [1, 2] * 40
    for it in range(150):
        n, sigma = int(rng.integers(0, 60)), int(rng.choice([1, 2, 3, 20]))
        base = rng.integers(1, sigma + 1, n)
        if it % 3 == 0 and n > 4:
            base = np.concatenate([base, base[: n // 2], base])
        if it % 7 == 0:
            base = np.repeat(base, rng.integers(1, 6, len(base)))
        if it % 5 == 0:
            base = base * 600 + rng.integers(0, 3, len(base))  # keys beyond single buckets
        yield base.tolist()


@pytest.mark.parametrize("memory,base", [(8, 0), (64, 0), (induced.MEMORY, 0), (induced.MEMORY, 1000)])
def test_suffixes_and_common_prefixes(memory, base):
    """Queues on disk and in memory, names sorted by recursion and by doubling."""
    for k, s in enumerate(strings()):
        text, cap, out = [*s, 0], (3, 7, 400)[k % 3], []
        induced.sort_suffixes(np.array(text, np.int32), cap, lambda p, v: out.append((p.copy(), v.copy())), memory, base)
        at = np.concatenate([o[0] for o in out])[::-1].tolist()
        lcp = [0, *np.concatenate([o[1] for o in out])[:0:-1].tolist()]
        order, want = brute_suffixes(text, cap)
        if base == 0:
            assert at == order
        assert [text[i : i + cap] for i in at] == [text[i : i + cap] for i in order] and lcp == want


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(30), prose(8)
    texts = [None, "", "short", "x" * 900, "ab" * 300, prose(100)]
    texts += [texts[5], texts[5], "ü" * 150 + passage]
    texts += [prose(rng.randint(5, 40)) + passage + prose(rng.randint(5, 40)) for _ in range(12)]
    texts += [prose(20) + line + prose(20) for _ in range(6)]
    twice = prose(40)
    texts += [twice + prose(10) + twice, prose(3000) + passage + "z"]
    near = prose(80).split()
    texts += [" ".join(near[:k] + ["changed"] + near[k:]) for k in (10, 40, 70)]
    return texts


@pytest.mark.parametrize("hot", [repeats.HOT_BYTES, 500])
def test_repeats_against_brute_force(spark, hot, monkeypatch):
    """The same with hashes that have too much for a task; extra columns may bear any name; ids repeat."""
    monkeypatch.setattr(repeats, "PIECE", 700)
    texts = corpus()
    df = spark.createDataFrame([(i // 2 or None, t, i, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long, kept string, _row int").repartition(3)
    got = {r.doc.n_bytes: r for r in repeats.without_repeats(df, 128, 32, hot).collect()}
    want = brute_repeats(texts, 128)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.runs), hashlib.sha256(r.kept).hexdigest()) == w, texts[i]
        assert sum(x["to"] - x["from"] for x in r.runs) == w[1]


def test_a_common_passage_is_dealt_to_all_tasks(spark, monkeypatch):
    """4,500 neighbours of one passage have more different segments than a task sorts at a time."""
    rng, dealt, deal = np.random.default_rng(1), [], repeats._hot_finds
    monkeypatch.setattr(repeats, "_hot_finds", lambda distinct, length: dealt.append(distinct.agg({"windows": "sum"}).first()[0]) or deal(distinct, length))
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage, k = some(400), 140
    texts = [some(k) + passage + some(k) for _ in range(4500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc.doc_id: [(x["from"], x["to"]) for x in r.runs] for r in repeats.without_repeats(df).collect()}
    assert len(dealt) == 1 and dealt[0] > 4500
    # a window besides the passage is repeated where the bytes next to it agree with another document's
    def agreeing(sides):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        most = [0] * len(sides)
        for i, j in zip(order, order[1:]):
            n = next(n for n in range(k + 1) if n == k or sides[i][n] != sides[j][n])
            most[i], most[j] = max(most[i], n), max(most[j], n)
        return most

    left, right = agreeing([t[:k][::-1] for t in texts]), agreeing([t[k + 400 :] for t in texts])
    assert got == {i: [(k - a, k + 400 + b)] for i, (a, b) in enumerate(zip(left, right))}


def test_empty_table_and_query(spark, no_docs, tmp_path):
    from meshspark.llm import queries

    assert repeats.without_repeats(no_docs).count() == 0
    texts = corpus() + ["y" * 401]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_repeats(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))

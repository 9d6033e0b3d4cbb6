"""Each operator against a brute-force version on a small table with every defined case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meshspark.llm import ann, bpe, kd_shards, maxent_lm, mixing, near_dedup, quality, repair, secrets, toxicity
from meshspark.llm.queries import vocabulary_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file())


def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


# 1 and 5: tokens


def test_bpe_equals_library(docs, library):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.encode_decode_digests(docs, vocabulary_file())))
    want = []
    for i, t, _ in plain(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_streams_long_runs_with_bounded_windows(library):
    v = bpe.vocabulary(vocabulary_file())
    enc, dec = bpe.Encoder(v), bpe.Decoder(v, block=7)
    rng = np.random.default_rng(3)
    for letters in ("ab", "aeinrst", "aé "):
        text = "".join(rng.choice(list(letters), 12_000))
        ids = enc.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert dec.decode(ids) == text
    assert np.frombuffer(enc.encode("a<|endoftext|> b"), "<u4").tolist() == library.encode("a<|endoftext|> b", add_special_tokens=False).ids
    assert 0 < v.lookahead < 4096


def test_memory_does_not_grow_with_a_run_or_a_text(library):
    import tracemalloc

    enc = bpe.Encoder(bpe.vocabulary(vocabulary_file()))
    rng = np.random.default_rng(9)
    enc.encode("warm up")
    peaks = []
    for n in (100_000, 800_000):
        text = "".join(rng.choice(list("aeinrst"), n)) + " some words\nand more" * (n // 20)
        tracemalloc.start()
        ids = [np.frombuffer(x, "<u4").tolist() if n == 100_000 else None for x in enc.pieces(text)]
        del ids
        tracemalloc.reset_peak()
        for _ in enc.pieces(text):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 1_500_000
    text = ("x" * 70_000 + " ab'll 12" * 9000 + "\n" + "word " * 20_000 + "end\n" + "y" * 200_000 + " z")
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode("  " + text), "<u4").tolist() == library.encode("  " + text, add_special_tokens=False).ids


def test_lookahead_of_a_small_merge_list():
    # "ab" may be undone by "bc", which comes first: two bytes beyond the boundary of "a" decide
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) >= 3


def test_token_shards_round_trip(docs, no_docs, library):
    got = rows(repair.read_shards(repair.write_shards(docs, vocabulary_file(), shard_tokens=500, rounds=3)))
    want, at = [], 0
    for i, t, _ in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])) for r in got)
    assert rows(repair.read_shards(repair.write_shards(no_docs, vocabulary_file()))) == []


def test_grammar_compresses_real_text(spark, library):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seqs = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]
    shard = repair.Shard(repair.pack(list(range(len(seqs))), seqs, 4))
    assert all((shard.tokens(i) == s).all() for i, s in enumerate(seqs))
    assert len(shard.symbols) + 2 * len(shard.rule_lengths) < 0.75 * sum(map(len, seqs))


def test_grammar_compresses_and_gives_random_access():
    rng = np.random.default_rng(1)
    seqs = [np.tile(rng.integers(0, 50, 20), 30).astype("<u4") for _ in range(20)] + [np.array([5], "<u4")]
    blob = repair.pack(list(range(21)), seqs, 4)
    shard = repair.Shard(blob)
    assert all((shard.tokens(i) == s).all() for i, s in reversed(list(enumerate(seqs))))
    assert len(shard.symbols) < sum(map(len, seqs)) / 2
    same = repair.Shard(repair.pack([1], [np.zeros(1001, "<u4")], 4))
    assert (same.tokens(0) == 0).all() and len(same.tokens(0)) == 1001


# 2: secrets


def brute_spans(t):
    t = t or ""
    out = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, t):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, r.kind, m.end()))
    return sorted(out)


def test_secret_spans(docs, no_docs):
    got = {(str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in rows(secrets.scan(docs))}
    want = set()
    for i, t, _ in plain(docs):
        s = brute_spans(t)
        text = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, k, b in x)
        n = Counter(x[2] for x in s)
        want.add((str(i), n["assign"], n["access"], n["hex"], hashlib.sha256(text([x for x in s if x[1] < 3]).encode()).hexdigest(), text(s)))
    assert got == want
    assert secrets.scan(docs).count() == docs.count()
    assert rows(secrets.scan(no_docs)) == []


def test_redaction(docs):
    by = {r["doc_id"]: r for r in rows(secrets.redact(docs)) if r["doc_id"] is not None}
    assert secrets.redact(docs).columns == docs.columns
    for i, t, _ in plain(docs):
        s = brute_spans(t)
        if i is not None and not s:
            assert by[i]["text"] == t
        elif i is not None:
            assert "[secret:" in by[i]["text"] and not any(t[a:b] in by[i]["text"] for a, _, _, b in s)


def test_very_many_matches_in_one_text(spark):
    text = "ü token=abcdef12 ghp_" + "a1" * 20 + " " + "é password:zzzzzzz9 key deadbeefdeadbeefdeadbeef99 x\n" * 6000 + "end"
    df = spark.createDataFrame([(1, text, 0, 0), (None, text, 0, 0), (2, "none", 0, 0)], "doc_id long, text string, spans int, row int")
    want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(text))
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.scan(df))}
    assert got == {1: want, None: want, 2: ""}
    out, at = [], 0
    for a, _, kind, b in brute_spans(text):
        if a >= at:
            out.append(text[at:a] + f"[secret:{kind}]")
        at = max(at, b)
    again = {r["doc_id"]: r["text"] for r in rows(secrets.redact(df))}
    assert again == {1: "".join(out) + text[at:], None: "".join(out) + text[at:], 2: "none"}
    assert secrets.redact(df).columns == df.columns


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    alts = secrets.trigram_query(secrets.RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in alts and frozenset({"api", "pik", "ike", "key"}) in alts
    assert len(secrets.trigram_query(r"gh[pousr]_[A-Za-z0-9]{36,}")) == 5


# 3: language model


def test_lm_scores(docs, no_docs):
    got = rows(maxent_lm.lm_scores(docs))
    assert len(got) == docs.count()
    count = Counter()
    for i, t, _ in plain(docs):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(maxent_lm.tokens(t))
    n, v = sum(count.values()), len(count)
    text = {i: t for i, t, _ in plain(docs)}
    for r in got:
        tk = maxent_lm.tokens(text[r["doc_id"]])
        assert r["train_tokens"] == n and r["n_tokens"] == len(tk) and r["n_known"] == sum(x in count for x in tk)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in tk), rel=1e-9)
        assert r["score"] < 0
    assert rows(maxent_lm.lm_scores(no_docs)) == []


def test_lm_learns_what_follows(spark):
    """Two languages that never mix: the neighbours tell which words can come, so held-out scores beat counts alone."""
    rng = np.random.default_rng(3)
    side = [["".join(rng.choice(list(a), 4)) + z for _ in range(150)] for a, z in (("bdgklm", "oa"), ("prstvz", "iu"))]
    data = [(i, " ".join(rng.choice(side[i % 2], 60))) for i in range(1200)]
    held = [r for r in rows(maxent_lm.lm_scores(spark.createDataFrame(data, "doc_id long, text string"))) if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.15 and np.mean([r["score"] > r["base_score"] for r in held]) > 0.95


def test_endings_are_grouped_by_their_neighbours():
    follow = np.zeros((maxent_lm.BUCKETS, maxent_lm.BUCKETS))
    for block in (range(0, 10), range(10, 30)):
        for i in block:
            for j in block:
                follow[i, j] = 5 + (i * j) % 3
    of = maxent_lm.group_endings(follow, 2)
    assert len(set(of[:10])) == 1 and len(set(of[10:30])) == 1 and of[0] != of[10]
    words = [b"abc", b"x", b"\xc3\xa9t\xc3\xa9"]
    assert maxent_lm.ending_buckets(b" ".join(words)).tolist() == [int(maxent_lm.bucket_of_ending(int.from_bytes(w[-2:], "little"))) for w in words]


def test_lm_is_a_distribution():
    """Over all words and unseen, the probabilities of the next word sum to one."""
    rng = np.random.default_rng(0)
    words = [b"w%d" % i for i in range(500)]
    h = maxent_lm.word_hashes(words)
    count = rng.integers(1, 50, 500)
    slot = (h & np.uint64((1 << maxent_lm.SLOT_BITS) - 1)).astype(np.int64)
    heads = (np.arange(0, 500) % 3 > 0) & np.isin(np.arange(500), np.unique(slot, return_index=True)[1])  # one frequent word for each slot
    c = maxent_lm.Classes(slot[heads], h[heads], count[heads], rng.integers(0, 999, heads.sum()), int(count.sum()), 500)
    w = rng.normal(size=(maxent_lm.N_ROWS, maxent_lm.CLASSES)).astype(np.float32)
    f = maxent_lm.features(h[:3], c.look(h[:3])[2], np.array([0]))
    lp = maxent_lm.log_softmax(w, f)[2]
    s, known, cls = c.look(h)
    after = maxent_lm.log_places(w, c, np.repeat(f[:, 2:], len(h), axis=1), cls, c.leaf_of_slot[s])  # every word after the same two
    inside = np.where(known, 10 ** c.log_share[s], (count + 1) / 10**c.log_tail)
    unseen = np.exp(lp[-1]) / 10**c.log_tail
    empty = sum(np.exp(lp[k]) for k in range(maxent_lm.CLASSES - 1) if not (cls == k).any())
    assert (np.exp(after) * inside).sum() + unseen + empty == pytest.approx(1, abs=1e-4)
    leafy = np.flatnonzero(maxent_lm.has_leaves(cls))
    assert len({(cls[i], c.leaf_of_slot[s[i]]) for i in leafy}) > 20  # several leaves a class
    for i in leafy[:40]:  # one word's class and leaf worked out plainly
        a, b = cls[i], c.leaf_of_slot[s[i]]
        z = c.log_leaf[a] + sum(w[r] for r in maxent_lm.leaf_features(f[:, 2:], np.array([a]))[:, 0])
        assert after[i] == pytest.approx(lp[a] + z[b] - np.log(np.exp(z.astype(float)).sum()), abs=1e-3)


def test_lm_sums_of_equal_feature_rows():
    rng = np.random.default_rng(4)
    g, row = rng.normal(size=(3000, 5)), (rng.random(3000) ** 6 * 900).astype(np.int64)
    u, n, s = maxent_lm.summed(g, row)
    assert sorted(u) == sorted(set(row))
    for a, b, c in zip(u, n, s):
        assert b == (row == a).sum() and np.allclose(c, g[row == a].sum(axis=0))


def test_lm_sums_of_several_features_at_once():
    """Rows of three features in one call, so that a step sorts once; some rows have far more lines than are added in layers."""
    rng = np.random.default_rng(5)
    g, f = rng.normal(size=(2048, 4)), np.stack([(rng.random(2048) ** 8 * 700).astype(np.int64) + 700 * k for k in range(3)])
    u, n, s = maxent_lm.summed(g, f.ravel())
    assert sorted(u) == sorted(set(f.ravel())) and n.max() > 200
    for a, b, c in zip(u, n, s):
        at = (f == a).any(axis=0)
        assert b == at.sum() and np.allclose(c, g[at].sum(axis=0))


def test_lm_step_is_a_plain_adagrad_step():
    rng = np.random.default_rng(6)
    f, cls = np.stack([rng.integers(0, 40, 500) + 40 * k for k in range(4)]), rng.integers(0, 5, 500)
    w, squares, seen = rng.normal(size=(160, 5)).astype(np.float32), rng.random((160, 5)).astype(np.float32), np.zeros(160, np.float32)
    z = w[f].sum(axis=0).astype(float)
    g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(5)[cls]
    grad, n = np.zeros((160, 5)), np.bincount(f.ravel(), minlength=160)
    for row in f:
        np.add.at(grad, row, g)
    grad /= np.sqrt(np.maximum(n, 1))[:, None]
    want_squares = squares + grad**2
    want = w - 0.15 * grad / np.sqrt(want_squares + 1e-2)
    maxent_lm.local_steps(w, seen, squares, f, cls)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(squares, want_squares, rtol=1e-3, atol=1e-4) and (seen == n).all()


def test_lm_lines_beyond_the_range_of_exp():
    """Alone and beside others, a line's log probabilities are the same; an empty batch has none."""
    z = np.array([[0, 1, -2], [200, 199, -300], [-200, -201, -500], [-np.inf, 3, 4]], np.float32)
    want = z.astype(float)
    want = want[:, 1] - want.max(axis=1) - np.log(np.exp(want - want.max(axis=1, keepdims=True)).sum(axis=1))
    for at in ([0, 1, 2, 3], [0, 3], [0, 2], [1], []):
        got = maxent_lm.log_chosen(z, np.array([at], np.int64), np.ones(len(at), np.int64))
        assert np.allclose(got, want[at], atol=1e-4)


def test_lm_predicts_words_inside_a_class(spark):
    """Words with one ending: 12 are classes, 16 are leaves of one class, and the previous word leaves three of them open.

    Without leaves the gain could be 0.97 - 16 / 28 * (log10(16) - log10(1.7)), about 0.42.
    """
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("bdgklmprst"), 5)) + "en" for _ in range(28)]
    data = []
    for i in range(1500):
        at = [int(rng.integers(28))]
        for _ in range(50):
            at.append((at[-1] * 5 + int(rng.integers(3))) % 28)
        data.append((i, " ".join(names[k] for k in at)))
    held = [r for r in rows(maxent_lm.lm_scores(spark.createDataFrame(data, "doc_id long, text string"))) if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.6  # at most log10(28 / 3) = 0.97


# 4: near-duplicates


def brute_classes(pairs, percent=85):
    sets = {}
    for i, t in pairs:
        w = [x.decode() for x in near_dedup.words_of(t)]
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs, no_docs):
    got = rows(near_dedup.near_duplicates(docs))
    want = brute_classes({(i, t) for i, t, _ in plain(docs) if i is not None})
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert rows(near_dedup.near_duplicates(no_docs)) == []
    stay = near_dedup.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Many near copies of one text, and chains of them, with small blocks so that every path of the join is taken."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "NODE", 8)
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(5000)]
    base = list(rng.choice(vocab, 120))
    pairs = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(110, i % 3 + 1, replace=False):
            w[int(k)] = f"x{i}_{k}"
        pairs.append((i, " ".join(w)))
    w = list(base)
    for i in range(90, 150):  # each a small step from the one before
        w = list(w)
        w[(i * 7) % 115] = f"y{i}"
        pairs.append((i, " ".join(w)))
    pairs += [(i, " ".join(rng.choice(vocab, 60))) for i in range(150, 200)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_duplicates(df))}
    assert got == brute_classes(pairs)


def alike(n, seed=4, links=True):
    """Texts that share about 0.6 of their shingles with every other one, and a near copy of every fourth."""
    rng = np.random.default_rng(seed)
    parts = [" ".join(f"w{k}_{j}" for j in range(14)) for k in range(70)]
    texts = []
    for i in range(n):
        own = [p for p, keep in zip(parts, rng.random(70) < 0.82) if keep]
        texts.append(" ".join(own))
        if links and i % 4 == 0:
            w = " ".join(own).split()
            w[int(rng.integers(len(w)))] = f"x{i}"
            w[int(rng.integers(len(w)))] = f"y{i}"
            texts.append(" ".join(w))
    order = rng.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)]


def test_documents_that_are_all_alike_lose_no_link(spark, monkeypatch):
    """Signatures tie all of them, full sets few: clusters must descend again."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "NODE", 8)
    pairs = alike(200)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_duplicates(df))} == brute_classes(pairs)


def test_rows_compared_grow_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "NODE", 8)
    plain_links, seen = near_dedup.verified_links, []

    def counted(rows, *how):
        seen.append(rows.count())
        return plain_links(rows, *how)

    monkeypatch.setattr(near_dedup, "verified_links", counted)
    made = []
    for n in (250, 1000):
        seen.clear()
        near_dedup.near_duplicates(spark.createDataFrame(alike(n, links=False), "doc_id long, text string").repartition(4)).count()
        made.append(sum(seen))
    assert made[1] < 10 * made[0]  # four times the documents, alike at 0.7: 4 ** 1.45 expected, all pairs would be sixteen times the rows


def test_trees_reach_the_recall(spark):
    """The share of pairs at the threshold that meet on a last level is what ``missed`` says."""
    assert near_dedup.missed(0.85, (2,)) == pytest.approx(0.15**2)
    assert near_dedup.missed(0.85, near_dedup.SEEK) ** near_dedup.trees_for(near_dedup.RECALL, 0.85, near_dedup.SEEK) < 1 - near_dedup.RECALL
    rng = np.random.default_rng(8)
    trees, met = 2, 0
    family = near_dedup.hash_family(trees * 16)
    sets = []
    for _ in range(600):
        common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (170, 15, 15))  # 170 of 200: 0.85
        sets += [np.concatenate([common, a]), np.concatenate([common, b])]
    reps = spark.createDataFrame([(i, bytearray(near_dedup.signature(x, family).tobytes())) for i, x in enumerate(sets)], "id long, sig binary")
    last = {}
    for r in rows(near_dedup.paths(reps, trees)):
        last.setdefault(r["id"], set()).add(r["last"])
    met = sum(bool(last[2 * k] & last[2 * k + 1]) for k in range(600))
    assert met / 600 == pytest.approx(1 - near_dedup.missed(0.85, near_dedup.SEEK) ** trees, abs=0.02)
    root = np.array([5], np.uint64)
    met = np.mean([len(np.intersect1d(near_dedup.deeper(root, a, near_dedup.DEEP), near_dedup.deeper(root, b, near_dedup.DEEP))) > 0 for a, b in zip(sets[::2], sets[1::2])])
    assert met == pytest.approx(1 - near_dedup.missed(0.85, near_dedup.DEEP), abs=0.06)


def test_near_duplicates_of_odd_rows(spark):
    """Text ids, a repeated id with two texts, clashing column names."""
    base = " ".join(f"w{k}" for k in range(60))
    data = [("b", base, 1, 2), ("a", base + " end", 3, 4), ("c", "another text of many words here", 5, 6), ("c", base.replace("w30 ", ""), 7, 8), (None, base, 9, 9)]
    df = spark.createDataFrame(data, "doc_id string, text string, id long, node long")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows(near_dedup.near_duplicates(df)))
    assert got == [("None", "None", True), ("a", "a", True), ("b", "a", False), ("c", "a", False), ("c", "c", True)]
    assert near_dedup.distinct_documents(df).columns == df.columns


def test_a_member_stays_member_where_it_is_also_guest(spark):
    """Two unconnected near copies of different parts, each guest of both blocks, with the guest rows first in the union."""
    sets = {k: np.arange(100 if k < 3 else 300, dtype=np.uint64) + np.uint64(k if k < 3 else 10_000 * k) for k in (1, 2, 3, 4)}
    schema = "block long, id long, comp long, guest boolean, shingles binary"
    row = lambda block, k, guest: (block, k, k, guest, bytearray(sets[k].tobytes()))
    guests = spark.createDataFrame([row(b, k, True) for b in (1, 2) for k in (1, 2)], schema).coalesce(1)
    hosts = spark.createDataFrame([row(1, 1, False), row(1, 3, False), row(2, 2, False), row(2, 4, False)], schema).coalesce(1)
    for union in (guests.unionByName(hosts), hosts.unionByName(guests)):
        links = {(r["a"], r["b"]) for r in rows(near_dedup.verified_links(union.coalesce(1), 85)) if r["a"] != r["b"]}
        assert links == {(1, 2)}


# 6: quality


def brute_features(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_features(docs, labels, no_docs):
    got = rows(quality.quality_verdicts(docs, labels))
    assert len(got) == docs.count()
    text = {i: t for i, t, _ in plain(docs)}
    for r in got:
        f = brute_features(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        assert r["base_failed"] == failed and (r["kept"] is False if failed else True)
    assert rows(quality.quality_verdicts(no_docs, labels)) == []
    assert all(r["kept"] == (not r["base_failed"]) for r in rows(quality.quality_verdicts(docs, labels.filter("false"))))


def test_certified_cutoffs(spark):
    """Good documents almost never exceed 0.3 symbols a word; the cutoff is certified there, not where they do."""
    from math import comb

    from pyspark.sql import functions as F

    tail = lambda k, n, p: sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    df = spark.createDataFrame([(k, n) for n in (30, 500) for k in (0, 1, 4)], "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        assert r["p"] == pytest.approx(tail(r["k"], r["n"], 0.01) if r["k"] <= r["n"] * 0.01 else 1.0, rel=1e-9)
    docs = spark.createDataFrame([(i, "word word two three " + "abcde fghi " * 2 + f"jklm nopq{i} rstu vwxyz " + "# " * (10 if i % 3 == 0 and i >= 6000 else 1), "en") for i in range(9000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 6000)) for i in range(9000)], "doc_id long, quality int")
    out = quality.quality_verdicts(docs, labels).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in out} == {True: 8000, False: 1000}


# 7: shards


def test_kd_shards(docs, no_docs):
    out = rows(kd_shards.kd_shards(docs, shards=5))
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(5))
    text = {i: (t or "").encode() for i, t, _ in plain(docs)}
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in out)
    assert rows(kd_shards.kd_shards(no_docs, shards=5)) == []


def test_kd_shards_are_even(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, "x" * int(rng.integers(1, 90)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(6000)], "doc_id long, text string, lang string, source string")
    size = Counter()
    for r in rows(kd_shards.kd_shards(df, target_bytes=10_000)):
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / len(size)
    assert max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean


# 8: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # one very common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(3001, None), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None] + [0.0] * 14), (3005, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    stats = {}
    got = {}
    for r in rows(ann.search(df, stats=stats)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20)) and stats["visits"] <= stats["leaves"]
    d, hit = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        s = (d * d[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(3000), -s)) if j != q][:20]
        hit += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[v] - sc) < 1e-9 for _, v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hit / (20 * len(got)) >= 0.9
    few = ann.search(df.filter("vec_id < 5 or vec_id > 3000"))
    assert few.count() == 4
    assert ann.search(df.filter("vec_id > 3000 and vec_id < 3005")).count() == 0


def test_queries_near_outliers_get_all_their_rows(spark, monkeypatch):
    """Small leaves and a low target, so calibration visits few: every query still finds k neighbours."""
    monkeypatch.setattr(ann, "LEAF", 20)
    rng = np.random.default_rng(7)
    x = np.repeat(10 * np.eye(16)[:8], 200, axis=0) + 0.05 * rng.normal(size=(1600, 16))
    x = np.concatenate([x, 100 * np.eye(16)[[15, 15, 15]] + 0.01 * rng.normal(size=(3, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist())] * 30, "vec_id long, embedding array<double>")
    found = Counter(r["query_id"] for r in rows(ann.search(df, target=0.01)))
    assert found == dict.fromkeys(range(0, 1603, 20), 20)
    tree = ann.Tree(x, 10)
    held = np.bincount(tree.assign(x), minlength=tree.n_leaves)
    assert held[tree.visits(x[1600], 1)].sum() == 3 and held[tree.visits(x[1600], 1, held, 21)].sum() >= 21
    assert sorted(tree.visits(x[0], 1, held, 10**9)) == list(range(tree.n_leaves))


# 9: toxicity


def test_toxicity_learns(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abdeilnorst"), rng.integers(2, 8))) for _ in range(400)]
    data, lab = [], []
    for i in range(1500):
        w = list(rng.choice(vocab, rng.integers(5, 120)))
        bad = i % 6 == 0
        if bad:
            w[int(rng.integers(len(w)))] = ["wretched", "vile", "scoundrel"][i % 3]
        data.append((i, " ".join(w)))
        lab.append((i, int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = rows(toxicity.toxicity(docs, spark.createDataFrame(lab, "doc_id long, toxic int")))
    held = [r for r in out if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert len(out) == 1500 and right / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_toxicity_cases(docs, labels, no_docs):
    out = rows(toxicity.toxicity(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["predicted"] for r in rows(toxicity.toxicity(docs, labels.filter("false")))} == {0}
    assert toxicity.clean(docs.withColumnRenamed("part", "score"), labels).columns == docs.withColumnRenamed("part", "score").columns


# 10: mixing


def test_mixing(docs, no_docs):
    got = rows(mixing.mix_copies(docs))
    assert len(got) == docs.count()
    size = Counter()
    for _, t, s in plain(docs):
        size[s] += len(WORD.findall(t or ""))
    goal = mixing.targets(dict(size))
    assert sum(goal.values()) == pytest.approx(sum(size.values())) or all(goal[s] == 3 * size[s] for s in size)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    most = max(r["size"] for r in got)
    assert all(abs(taken[s] - goal[s]) <= most * 1.01 for s in size)
    again = rows(mixing.mix_copies(docs.repartition(7)))
    key = lambda x: sorted(str((r["doc_id"], r["source"], r["text_key"], r["copies"])) for r in x)
    assert key(got) == key(again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert rows(mixing.mix_copies(no_docs)) == []


def test_targets_are_capped():
    goal = mixing.targets({"a": 10, "b": 1000, None: 990, "c": 0})
    assert goal["a"] == 30 and goal["c"] == 0 and sum(goal.values()) == pytest.approx(2000) and max(goal["b"] / 1000, goal[None] / 990) <= 3

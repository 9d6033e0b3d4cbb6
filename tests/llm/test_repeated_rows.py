"""Rows that share ids: near copies, equal rows, bounded samples."""

import random


def words(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 99)) for _ in range(n)]


def test_near_copies_under_one_id_go(spark):
    from meshspark.llm.near_dedup import distinct_documents, near_duplicates

    rng = random.Random(1)
    base, other, far = words(rng, 60), words(rng, 60), words(rng, 60)
    near = base[:30] + base[31:] + ["end"]
    rows = [(1, base), (5, other), (5, near), (5, other), (7, far), (7, far[:-1]), (7, [w.upper() for w in far]), (None, base)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (9, ""), (9, " ")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in distinct_documents(df, percent=80).collect())
    j = " ".join
    assert [g for g in got if g[0] not in (7, 9)] == sorted([(0, j(base)), (1, j(base)), (5, j(other))])
    assert len([g for g in got if g[0] == 7]) == 1  # three texts of one class under one id: one stays
    assert len([g for g in got if g[0] == 9]) == 3  # texts without words are linked with nothing
    c = near_duplicates(df, percent=80).collect()
    assert len(c) == 11 and {r.component_id for r in c if r.doc_id == 5} == {1, 5}


def test_many_texts_under_one_id_do_not_multiply(spark):
    from meshspark.llm.near_dedup import near_duplicates

    rng = random.Random(2)
    base = words(rng, 60)
    rows = []
    for k in range(400):
        w = list(base)
        w[k % 60] = f"changed{k}"
        rows.append((3, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string"), percent=80).collect()
    assert len(got) == 800 and {r.component_id for r in got} == {3}


def test_equal_rows_fill_shards_evenly(spark):
    from meshspark.llm.kd_shards import kd_shards

    rows = [(1, "x" * 100, "s", "en")] * 2000 + [(i, "y" * i, "t", "de") for i in range(2, 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd_shards(df, shards=5).collect()
    size = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert len(got) == 2050 and max(size) - min(size) <= 2 * 116
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_kd_tree_against_brute_force(spark):
    """Each shard of the tree ends up at its share of the bytes, and cuts keep the order of the dimension they cut."""
    from pyspark.sql import functions as F

    from meshspark.llm.common import written
    from meshspark.llm.kd_shards import kd_assign

    rng = random.Random(3)
    meta = [(i, float(rng.randint(0, 1000)), float(i % 3), rng.randint(10, 60)) for i in range(600)]
    df = written(spark.createDataFrame(meta, "id long, a double, b double, size long"), "kd-test")
    put = {r.id: r.shard for r in kd_assign(df, ["a", "b"], "size", F.xxhash64("id"), shards=4).collect()}

    def split(rows, leaves, first, whole):
        if leaves == 1:
            return {r[0]: first for r in rows}
        spread = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / whole[d] for d in (1, 2)]
        d = 1 + (spread[1] > spread[0])
        want = sum(r[3] for r in rows) * (leaves // 2) / leaves
        left = {r[0] for r in rows if put[r[0]] < first + leaves // 2}
        assert abs(sum(r[3] for r in rows if r[0] in left) - want) <= 60
        cut = max(r[d] for r in rows if r[0] in left)
        assert all(r[d] >= cut or cut - r[d] < 1e-3 for r in rows if r[0] not in left)
        return split([r for r in rows if r[0] in left], leaves // 2, first, whole) | split([r for r in rows if r[0] not in left], leaves - leaves // 2, first + leaves // 2, whole)

    whole = {d: max(r[d] for r in meta) - min(r[d] for r in meta) for d in (1, 2)}
    assert split(meta, 4, 0, whole) == put


def test_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    from meshspark.llm import toxicity

    rows = [(1, f"good text number {i}") for i in range(200)] + [(2, f"bad awful words {i}") for i in range(100)] + [(2, "bad awful words 5")] * 50 + [(3, "fine words"), (4, "bad awful thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda flat, n, y, *a, **k: seen.append(len(y)) or train(flat, n, y, *a, **k))
    toxicity.fit(docs, labels, holdout=None, sample=60)
    assert seen == [60]
    toxicity.fit(docs, labels, holdout=None, sample=1000)
    assert seen[1] == 302  # one row for each text of an id


def test_search_with_repeated_ids(spark):
    from meshspark.llm import ann

    rng = random.Random(4)
    rows = [(i % 40, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert {r.query_id for r in got} == {0, 20} and len(got) == 10

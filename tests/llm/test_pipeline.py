"""The pipeline against a brute-force version of its stages."""

import pytest


def test_stages_take_effect(spark, docs, labels, tmp_path):
    import corpus_pipeline as p
    from meshspark.llm import bpe, mixing, near_dedup, secrets, toxicity
    from meshspark.llm.queries import vocabulary_file

    from .test_operators import brute_classes, brute_spans

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "bpe"]
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, p.run(spark, str(tmp_path)).collect()))

    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    classes = brute_classes(list(text.items()))
    kept = {i: t for i, t in text.items() if classes[i][1] == i}
    for i, t in kept.items():
        for a, _, kind, b in reversed(merged(brute_spans(t))):
            t = t[:a] + f"[secret:{kind}]" + t[b:]
        kept[i] = t
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    cleaned = spark.createDataFrame([(i, t, source[i]) for i, t in kept.items()], "doc_id long, text string, source string")
    want = []
    enc = bpe.encoder(vocabulary_file())
    for r in mixing.mix_copies(cleaned).collect():
        want += [(r["doc_id"], len(enc.encode(kept[r["doc_id"]])) // 4)] * r["copies"]
    assert [(g[0], g[1]) for g in got] == sorted(want)
    assert secrets and near_dedup and pytest


def merged(spans):
    out = []
    for a, o, k, b in spans:
        if out and a < out[-1][3]:
            out[-1] = (*out[-1][:3], max(b, out[-1][3]))
        else:
            out.append((a, o, k, b))
    return out

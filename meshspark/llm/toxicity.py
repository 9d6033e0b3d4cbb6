"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed byte n-grams (3 to 5) of a lower-case text, present or not.  From at most
``SAMPLE`` labelled training documents (the bound; chosen by a hash of the id) come the document
frequencies of each feature by class, their log ratios r, and the ``FEATURES`` most telling features;
a logistic regression on the ratios of a text's features gives the weights.  Every document is scored
over its whole text.

Defined cases: null and empty texts have no features and score at the intercept; labels of one id are
combined by the highest; null labels and ids are not trained on; without both classes in training,
every score is the share of toxic labels (0 if there are none).  Rows are scored one by one, repeated
ones alike; of an id's texts each trains once, within the bound; an empty table gives an empty result;
``clean`` keeps all columns whatever their names, ``toxicity`` returns the id and its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, written

BITS = 19
ORDERS = (3, 4, 5)
#: At most so many labelled documents are trained on.
SAMPLE = 30_000
FEATURES = 8192


def hashed_ngrams(raw: np.ndarray) -> list[np.ndarray]:
    """For each order: the slot of the n-gram that starts at each byte."""
    code = raw.astype(np.uint64)
    out = []
    for n in range(1, max(ORDERS) + 1):
        if len(raw) < n:
            break
        if n > 1:
            code = code[:-1] | (raw[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
        if n in ORDERS:
            out.append((((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)


def text_slots(text: str | None, block: int = 1 << 18) -> np.ndarray:
    """Distinct slots of a whole text, worked out in overlapping blocks."""
    raw, seen = text_bytes(text), []
    for i in range(0, len(raw), block):
        grams = hashed_ngrams(raw[i : i + block + max(ORDERS) - 1])
        if grams:
            seen.append(np.unique(np.concatenate(grams)))
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int32)


def train(flat: np.ndarray, n: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 200, rate: float = 0.05, penalty: float = 1e-4, block: int = 1 << 20):
    """Logistic regression on ``ratio`` of each row's features; returns weights (already scaled) and the intercept.

    ``flat`` holds the rows' feature places one after the other, ``n`` how many each row has.  Every
    step takes all rows, in blocks of about ``block`` places, so little memory is held beside ``flat``.
    """
    end = np.cumsum(n, dtype=np.int64)
    cuts = np.unique(np.searchsorted(end, np.arange(0, end[-1] if len(end) else 0, block), side="left"))
    pieces = [(a, b, int(end[a - 1]) if a else 0, int(end[b - 1])) for a, b in zip([0, *cuts[cuts > 0]], [*cuts[cuts > 0], len(n)]) if b > a]
    w, b = np.zeros(len(ratio)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        scaled, g, gb = w * ratio, np.zeros_like(w), 0.0
        for i, j, lo, hi in pieces:
            of, at = np.repeat(np.arange(j - i), n[i:j]), flat[lo:hi].astype(np.int64)
            z = np.bincount(of, scaled[at], minlength=j - i) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) / len(y)
            g += np.bincount(at, err[of], minlength=len(w))
            gb += err.sum()
        g = g * ratio + penalty * w / len(w) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k = rate * (1 - t / (steps + 1)) ** 0.5
        w -= k * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= k * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w * ratio, b


def fit(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] | None = (4, 2), sample: int = SAMPLE, id_col="doc_id", text_col="text", label_col="toxic"):
    """(slots, weights, intercept), learnt from labelled documents outside the holdout (crc32 of the id modulo n equals k)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if holdout:
        known = known.filter(crc_remainder(F.col(id_col), holdout[0]) != holdout[1])
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    bounded = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most ``sample`` ids
    drawn = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key")).join(F.broadcast(bounded), F.col(id_col) == F.col("_id"))
    texts = written(drawn.select("_y", "_text", "_id", "_key"), "toxicity-sample")
    rows, distinct = texts.count(), texts.select("_id", "_key").distinct()
    if rows > distinct.count() or rows > sample:  # repeated ids: one row for each text, and ``sample`` of these at most
        least = distinct.orderBy(F.xxhash64("_id", "_key"), "_id", "_key").limit(sample)
        texts = written(texts.dropDuplicates(["_id", "_key"]).join(F.broadcast(least), ["_id", "_key"]), "toxicity-sample")
    texts = texts.select("_y", "_text")

    def frequencies(batches):
        import pyarrow as pa

        count = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1)):
                count[1 if y else 0, text_slots(text.as_py())] += 1
        at = np.flatnonzero(count.any(axis=0))
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(count[1, k].astype(np.int64)), pa.array(count[0, k].astype(np.int64))], ["slot", "pos", "neg"])

    totals = {r["y"]: r["n"] for r in texts.groupBy((F.col("_y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        p = min(max(n1 / max(1, n1 + n0), 1e-9), 1 - 1e-9)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p)))
    freq = texts.mapInArrow(frequencies, "slot int, pos long, neg long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = F.abs(F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    best = freq.filter("pos + neg >= 3").withColumn("z", z).orderBy(F.desc("z"), "slot").limit(FEATURES).toPandas()  # at most FEATURES rows
    slots = best["slot"].to_numpy(np.int64)
    p, q = best["pos"].to_numpy(float) + 1, best["neg"].to_numpy(float) + 1
    ratio = np.log((p / (n1 + 2)) / (q / (n0 + 2)))
    place = np.full(1 << BITS, -1, np.int32)
    place[slots] = np.arange(len(slots))

    def sparse(batches):
        import pyarrow as pa

        for b in batches:
            rows = [place[s][place[s] >= 0].astype("<u2").tobytes() for s in (text_slots(x.as_py()) for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(rows, pa.binary())], ["y", "rows"])

    # bounded by ``sample`` rows of at most FEATURES places, two bytes each
    own = texts.mapInArrow(sparse, "y int, rows binary").toArrow()
    y = (own.column("y").to_numpy() > 0).astype(float)
    chunks = own.column("rows").chunks
    n = np.concatenate([np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in chunks]) // 2
    flat = np.concatenate([np.frombuffer(x.as_py(), "<u2") for c in chunks for x in c])
    del own, chunks
    w, b = train(flat, n, y, ratio)
    return slots, w, b


def score(docs: DataFrame, model, threshold: float = 0.3, holdout: tuple[int, int] = (4, 2), id_col="doc_id", text_col="text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted), one row for each document; with ``keep``, the documents with these columns added."""
    slots, weights, intercept = model
    table = np.zeros(1 << BITS, np.float32)
    table[slots] = weights
    chosen = np.zeros(1 << BITS, bool)
    chosen[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast((table, chosen))  # 2^BITS entries

    def of(texts):
        table, chosen = shared.value
        out = []
        for text in texts:
            raw, z, seen = text_bytes(text), intercept, []
            for i in range(0, len(raw), 1 << 18):
                for g in hashed_ngrams(raw[i : i + (1 << 18) + max(ORDERS) - 1]):
                    seen.append(g[chosen[g]])
            if seen:
                z += float(table[np.unique(np.concatenate(seen))].sum(dtype=np.float64))
            out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
        return out

    @F.pandas_udf("double")
    def scored(s):
        import pandas as pd

        return pd.Series(of(s), index=s.index)

    scored = scored.asNondeterministic()  # worked out once, not once for each use
    out = docs.withColumn("_score_", scored(F.col(text_col)))
    added = [(crc_remainder(F.col(id_col), holdout[0]) == holdout[1]).alias("held_out"), F.col("_score_").alias("score"), (F.col("_score_") >= threshold).cast("int").alias("predicted")]
    return out.select(*(docs.columns if keep else [id_col]), *added)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """(id, held_out, score, predicted), one row for each document."""
    return score(docs, fit(docs, labels, **how), threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    own = {"id_col": how.get("id_col", "doc_id"), "text_col": how.get("text_col", "text")}
    named = docs.toDF(*[f"_d_{i}" for i in range(len(docs.columns))])  # so that no column clashes with those added
    at = {k: f"_d_{docs.columns.index(v)}" for k, v in own.items()}
    return score(named, fit(docs, labels, **how), threshold, keep=True, **at).filter("predicted = 0").select(*named.columns).toDF(*docs.columns)

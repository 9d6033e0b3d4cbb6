"""Whitening against an eigendecomposition of the covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.llm import whitening


def brute(rows, most=16):
    ok = [(i, np.floor(64 * np.asarray(v, float)).astype(int) + 10**6) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}))
    n, sums = len(fit), fit.sum(0)
    c = (fit * n - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return ok, n, sums, e[order], v[:, order]


def test_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # a tree of several levels
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (500, None), (501, [None] + rows[0][1][1:]), (502, [float("nan")] + rows[0][1][1:]), (503, [float("inf")] + rows[0][1][1:]), (504, [1.0, 2.0]), (505, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, component int, n long").repartition(9)
    got = whitening.whiten(df).collect()
    ok, n, sums, e, v = brute([r for r in rows if r[0] not in (504, 505)])
    assert len(got) == 16 * len(ok) == 16 * 122 and {r.n for r in got} == {120}
    assert max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    want = {i: (x * n - sums) / n @ v[:, :16] / np.sqrt(e[:16]) for i, x in ok}
    for k in range(16):
        one = np.array([by[i, k + 1][0].whitened for i, _ in ok])
        two = np.array([want[i][k] for i, _ in ok])
        assert np.allclose(one * np.sign(one @ two), two, atol=1e-9)
        assert by[0, k + 1][0].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    for i, x in ok:
        assert {r.deviation for k in range(1, 17) for r in by[i, k]} == {int(((x * n - sums) ** 2).sum())}
    assert len(by[7, 1]) == 2 and len(by[None, 1]) == 1


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.filter("false")).count() == 0
    assert whitening.whiten(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_jacobi_and_exact_sums():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 12):
        r = np.triu(rng.normal(size=(d, d))) * 10.0 ** rng.integers(-6, 3, d)
        length, v = whitening.jacobi(r)
        assert np.allclose(length, np.linalg.svd(r, compute_uv=False), rtol=1e-12, atol=1e-13 * length[0])
        # small lengths are accurate too, where columns differ in size: their product is the determinant's
        assert np.prod(length) == pytest.approx(np.prod(np.abs(np.diag(r))), rel=1e-11)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    far = whitening.centred(np.array([[1 << 40, 3]]), 1 << 30, np.array([5, 7], object))
    assert far.tolist() == [[(1 << 70) - 5, 3 * (1 << 30) - 7]] and whitening.deviations(far) == [None]
    assert whitening.deviations(np.array([[3, -4]])) == [25]

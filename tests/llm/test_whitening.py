"""Whitening against a plain eigen-decomposition, exact sums against whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankshift.llm import queries, whitening

FIELDS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, k=16):
    """[(vec_id, x)] -> (kept rows, n, S, covariance, falling eigenvalues) with exact sums."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, total)] for x in fit], dtype=object)
    cov = np.array([[float(c) for c in r] for r in (y.T @ y)]) / float(n) ** 3
    return kept, n, total, cov, np.linalg.eigvalsh(cov)[::-1][:k]


def check(rows, got):
    kept, n, total, cov, values = plain(rows)
    k = min(16, int((values > values[0] * 1e-10).sum()))
    assert len(got) == k * len(kept)
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    want = {}
    for i, x in kept:
        c = [n * a - s for a, s in zip(x, total)]
        want.setdefault(i, []).append((sum(v * v for v in c), c))
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
    assert set(by_id) == set(want)
    for i, rs in by_id.items():
        assert {r["deviation"] for r in rs} == {d for d, _ in want[i]}
    # whitened = W^T c / n: the Mahalanobis length in the kept directions is basis-free
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    for i, rs in by_id.items():
        if len(want[i]) == 1:
            w = np.array([r["whitened"] for r in sorted(rs, key=lambda r: r["component"])])
            p = (np.array(want[i][0][1], float) / n) @ vector / np.sqrt(value)
            gaps = np.abs(np.subtract.outer(value, value) + np.eye(k) * 1e9).min(1)
            clear = gaps > 1e-6 * value[0]
            assert np.abs(np.abs(w) - np.abs(p))[clear].max(initial=0) < 1e-6
            if clear.all():
                assert (w ** 2).sum() == pytest.approx((p ** 2).sum(), rel=1e-6, abs=1e-9)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, dim int")
    return whitening.op13(df.repartition(5)).collect()


def table(rng, n, d):
    x = (rng.standard_normal((n, d)) * np.linspace(1, 4, d)).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, d", [(200, 24), (300, 5), (10, 24), (1, 4)])
def test_equals_plain(spark, n, d):
    rows = table(np.random.default_rng(n), n, d)
    rows += [(1000, None), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [1.0] * (d - 1) + [float("inf")]),
             (1004, rows[0][1]), (1004, rows[0][1]), (None, rows[0][1])]
    got = run(spark, rows)
    if n == 1:
        assert got == []  # one distinct vector has no variance
    else:
        check(rows, got)


def test_empty_lengths_and_large_entries(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    rng = np.random.default_rng(7)
    two, three = table(rng, 30, 2), [(100 + i, v) for i, v in table(rng, 30, 3)]
    got = run(spark, two + three)
    check(two, [r for r in got if r["vec_id"] < 100])
    check(three, [r for r in got if r["vec_id"] >= 100])
    huge = [(i, [float(np.float32(1e30 * (i % 3))), float(i)]) for i in range(9)]
    assert all(r["deviation"] == 2**63 - 1 for r in run(spark, huge) if r["component"] == 1 and r["vec_id"] % 3)


@pytest.mark.parametrize("values", [
    [1.0] * 30, [1.0] * 10 + [2.0] * 10 + [3.0] * 10, list(10.0 ** -np.arange(30)), [5.0, 0.0, 0.0],
    list(np.linspace(1, 2, 40)), [1.0] * 15 + [1 - 1e-13] * 15])
def test_intervals_hold_every_eigenvalue(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))
    cov = (q * np.array(values)) @ q.T
    cov = (cov + cov.T) / 2
    parts = whitening.intervals(cov, 16)
    got = []
    for low, high, inside in parts:
        value, vector = whitening.feast(cov, low, high, inside)
        assert len(value) == inside
        got += list(value)
    want = np.linalg.eigvalsh(cov)[::-1]
    rank = int((want > want[0] * 1e-12).sum())
    assert len(got) >= min(16, rank)
    assert np.allclose(sorted(got, reverse=True), want[:len(got)], atol=1e-13 * d)
    tri = whitening.tridiagonal(cov)
    shifts = np.array([want[0] * 2, want[0] * 0.75, want[0] * 1.7e-3])
    assert list(whitening.count_above(tri, shifts)) == [int((want > s).sum()) for s in shifts]


def test_query(spark):
    got = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01")
    assert got.columns == FIELDS
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, got.collect())
    again = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01")
    assert got.agg(F.sum("deviation")).first() == again.agg(F.sum("deviation")).first()

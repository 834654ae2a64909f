"""Whitening of embeddings by FEAST contour integration.

1. Every entry becomes a whole number; the fit list is the distinct vectors.
2. Sums and then products of entries centred at whole numbers near the mean
   are added up exactly (whole numbers in doubles and longs), so the
   covariance does not depend on partitioning and is right to the last bit.
3. Inertia counts (signs of the LDL^T pivots of the shifted, tridiagonalised
   covariance) place cuts in the widest gaps of the wanted part of the
   spectrum.  Each interval between two cuts is one Spark row: FEAST projects
   a random block onto it by Gauss-Legendre quadrature of complex shifted
   solves on a circle, Rayleigh-Ritz extracts the pairs, until the residuals
   stop falling (rounding level).  The number of pairs found in an interval
   must equal its inertia count.  A last Rayleigh-Ritz step over all intervals
   together makes the components orthogonal to rounding.
4. One more pass over the fit list takes the covariance of the whitened
   values and its distance from the identity; a last one projects all rows.

What meets on the driver: d sums and d x d covariance cells (d = vector
length, at most ``MAX_DIM``), the components, and a ``k x k`` matrix; all
gathered as cells after a distributed sum.  Nothing grows with the rows.

Defined results: vectors that are null or empty or hold null or non-finite
entries are dropped; rows of each vector length are a table of their own
(own n, own components); scaled entries of 2**53 and more stay as they are
cut to the long range; a deviation beyond the long range is the largest
long; directions without variance (fewer distinct vectors than components,
constant columns) cannot be scaled to one, so they give no component and a
table with one distinct vector gives no rows; of equal eigenvalues any basis
may be returned; repeated rows and null ids give rows like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import materialize

MAX_DIM = 2048   # the covariance of longer vectors is not held on the driver
SLICE = 6        # eigenvalues an interval aims at
SPREAD = 10.0    # largest and smallest eigenvalue of an interval: its circle must tell the small ones from zero
CLUSTER = 1e-9   # gaps below this part of the eigenvalue are not cut
NODES = 16       # quadrature points on the upper half circle
ROUNDS = 40      # refinements of one interval
SHIFT = 1_000_000
EXACT = 2.0**53
PART = 10**18     # sums of whole numbers of any size travel in two parts
CELLS = "dim int, high array<string>, low array<long>"


def whole_vectors(df: DataFrame, vec_col: str, scale: float, shift: int = SHIFT) -> DataFrame:
    """``df`` plus x array<long> and dim, for the rows that take part."""
    v = F.transform(vec_col, lambda e: F.lit(scale) * e.cast("double"))
    good = (F.size(vec_col) > 0) & F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # floor() of a double is a long and fails beyond its range; such entries are whole already
    low, high = F.lit(float(-2**62)), F.lit(float(2**62))
    whole = F.transform(v, lambda e: F.floor(F.least(F.greatest(e, low), high)) + F.lit(shift))
    return df.where(F.coalesce(good, F.lit(False))).withColumn("x", whole).withColumn("dim", F.size("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batches):
    """(dim, matrix) of every run of rows of one length in Arrow batches with columns dim and x."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            yield int(d), _matrix(b.column("x").filter(pa.array(dims == d)), int(d))


def _sum_cells(parts: DataFrame) -> dict[int, list[int]]:
    """Exact sums of the cells ``high * PART + low``, by dim."""
    cells = (parts.select("dim", F.posexplode(F.arrays_zip("high", "low")).alias("i", "c"))
             .groupBy("dim", "i").agg(*(F.sum(F.col(f"c.{p}").cast("decimal(38,0)")).alias(p) for p in ("high", "low"))))
    found: dict[int, dict[int, int]] = {}
    for dim, i, high, low in cells.toLocalIterator():
        found.setdefault(dim, {})[i] = int(high) * PART + int(low)
    return {d: [f[i] for i in range(len(f))] for d, f in found.items()}


def _partial(make):
    """A mapInArrow function: ``make(matrix) -> list of ints`` summed per task and length."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for dim, m in _by_dim(batches):
            got = make(dim, m)
            sums[dim] = sums[dim] + got if dim in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([[str(int(c) // PART) for c in s] for s in sums.values()]),
                 pa.array([[int(c) % PART for c in s] for s in sums.values()], pa.list_(pa.int64()))],
                names=["dim", "high", "low"])

    return run


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, sums per dimension)}, exact."""

    def make(dim, m):
        small = float(np.abs(m).max(initial=0)) * len(m) < EXACT
        total = m.sum(0) if small else m.astype(object).sum(0)
        return np.array([len(m), *total], dtype=object)

    return {d: (c[0], c[1:]) for d, c in
            _sum_cells(fit.select("dim", "x").mapInArrow(_partial(make), CELLS)).items()}


def covariances(fit: DataFrame, stats: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """{dim: covariance}: exact products centred at round-down means, then corrected for the remainder."""
    centre = {d: [s // n for s in total] for d, (n, total) in stats.items()}

    def make(dim, m):
        y = m - np.array(centre[dim], dtype=np.int64)
        top = float(np.abs(y).max(initial=0))
        if top * top * len(y) < EXACT:
            f = y.astype(float)
            return (f.T @ f).astype(np.int64).astype(object).ravel()
        y = y.astype(object)
        return (y.T @ y).ravel()

    parts = fit.select("dim", "x").mapInArrow(_partial(make), CELLS)
    out = {}
    for d, cells in _sum_cells(parts).items():
        n, total = stats[d]
        g = np.array(cells, dtype=object).reshape(d, d)
        rest = np.array([s - n * c for s, c in zip(total, centre[d])], dtype=object)
        out[d] = _ratio(n * g - np.outer(rest, rest), n * n)
    return out


def _ratio(num: np.ndarray, den: int) -> np.ndarray:
    return np.array([x / den for x in num.ravel()], dtype=float).reshape(num.shape)  # int / int rounds correctly


# ------------------------------------------------------------ eigenvalues of one covariance

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of the Householder tridiagonal form."""
    a = a.copy()
    n = len(a)
    for j in range(n - 2):
        x = a[j + 1:, j].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = a[j + 1:, j + 1:] @ x
        w = p - (x @ p) * x
        a[j + 1:, j + 1:] -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[j + 1:, j] -= 2 * (x @ a[j + 1:, j]) * x
        a[j, j + 1:] = a[j + 1:, j]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Inertia: eigenvalues above each shift = positive pivots of LDL^T of (T - shift)."""
    diag, off = tri
    tiny = np.finfo(float).tiny * max(1.0, float(np.abs(off).max(initial=0)) ** 2)
    count, pivot = np.zeros(len(shifts), int), np.ones(len(shifts))
    for j, d in enumerate(diag):
        pivot = d - shifts - (off[j - 1] ** 2 / pivot if j else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def edges(tri, low: float, high: float) -> np.ndarray:
    """Approximate places of all eigenvalues in (low, high], largest first, by bisection on inertia counts."""
    n = len(tri[0])
    lo, hi = np.full(n, low), np.full(n, high)
    for _ in range(64):
        mid = (lo + hi) / 2
        above = count_above(tri, mid) > np.arange(n)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def intervals(cov: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(lower end, upper end, eigenvalues inside), from the top down to the ``k``-th at least.

    Cuts lie in the widest gap in reach (``SLICE`` eigenvalues, a factor ``SPREAD``) and never inside a cluster
    (gaps below ``CLUSTER`` of the eigenvalue, or at rounding level), so an interval may hold more than
    ``SLICE`` eigenvalues: all of an equal group."""
    tri = tridiagonal(cov)
    top = float(np.abs(cov).sum(1).max())
    floor_ = 16 * len(cov) * np.finfo(float).eps * top
    rank = int(count_above(tri, np.array([floor_]))[0]) if top > 0 else 0
    k = min(k, rank)
    if not k:
        return []
    place = edges(tri, -top * 1e-9, top * (1 + 1e-9))[:rank]
    under = np.append(place[1:], floor_ / 4)  # below the last one with variance lies nothing of use
    gap = np.append((place - under)[:-1], np.inf)
    cuts, at = [], 0
    while at < k:
        reach = at + int((place[at:at + SLICE + SLICE // 2] >= place[at] / SPREAD).sum())
        first, last = (k, reach) if reach >= k else (at + (min(reach - at, SLICE) + 1) // 2, min(reach, at + SLICE))
        cut = first + int(np.argmax(gap[first - 1:last]))
        while gap[cut - 1] <= max(CLUSTER * place[cut - 1], floor_ / 4):
            cut += 1
        cuts.append(cut)
        at = cut
    ends = [max(floor_, float(np.sqrt(place[c - 1] * under[c - 1]))) for c in cuts]
    above = [0, *map(int, count_above(tri, np.array(ends)))]
    return [(lo, hi, b - a) for hi, lo, a, b in zip([top * (1 + 1e-9), *ends], ends, above, above[1:])]


def feast(cov: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``cov`` in (low, high], ``inside`` of them by its inertia count."""
    d = len(cov)
    size = min(d, max(inside + 8, 2 * inside))
    mid, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (x + 1)  # upper half circle; the lower half is its conjugate
    y = np.random.default_rng(d).standard_normal((d, size))
    small, worst = 64 * np.finfo(float).eps * d * float(np.abs(cov).max()), np.inf
    for _ in range(ROUNDS):
        q = np.zeros((d, y.shape[1]))
        for a, weight in zip(angle, w):
            turn = radius * np.exp(1j * a)
            q += weight / 2 * np.real(turn * np.linalg.solve((mid + turn) * np.eye(d) - cov, y.astype(complex)))
        basis, s, _ = np.linalg.svd(q, full_matrices=False)
        basis = basis[:, s > s[0] * 1e-14]
        value, inner = np.linalg.eigh(basis.T @ cov @ basis)
        y = basis @ inner
        # ends lie in gaps, so rounding does not move a value across one
        mine = (value > low) & (value <= high)
        residual = np.linalg.norm(cov @ y[:, mine] - y[:, mine] * value[mine], axis=0).max(initial=0)
        done = mine.sum() == inside and residual <= small
        if done and residual >= worst / 2:  # no further gain
            break
        worst = residual if done else np.inf
    return value[mine], y[:, mine]


def components(spark, covs: dict[int, np.ndarray], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dim: (values falling, unit vectors as columns)} of at most ``k`` components.  One row of the job is one
    interval of one covariance; the covariance travels with the row."""
    rows = [(d, lo, hi, n, cov.astype("<f8").tobytes()) for d, cov in covs.items() for lo, hi, n in intervals(cov, k) if n]
    if not rows:
        return {}

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                value, vector = feast(np.frombuffer(r.cov, "<f8").reshape(r.dim, r.dim), r.low, r.high, r.inside)
                yield pd.DataFrame({"dim": [r.dim], "low": [r.low], "inside": [r.inside], "found": [len(value)],
                                    "vectors": [np.ascontiguousarray(vector.T).astype("<f8").tobytes()]})

    todo = spark.createDataFrame(rows, "dim int, low double, high double, inside int, cov binary").repartition(len(rows))
    got = todo.mapInPandas(run, "dim int, low double, inside int, found int, vectors binary").collect()
    out = {}
    for d in {r["dim"] for r in got}:
        mine = sorted((r for r in got if r["dim"] == d), key=lambda r: -r["low"])
        if wrong := [(r["low"], r["inside"], r["found"]) for r in mine if r["inside"] != r["found"]]:
            raise ArithmeticError(f"interval, inertia count and pairs found differ: {wrong}")
        basis, _ = np.linalg.qr(np.concatenate([np.frombuffer(r["vectors"], "<f8").reshape(-1, d) for r in mine]).T)
        value, inner = np.linalg.eigh(basis.T @ covs[d] @ basis)
        order = np.argsort(-value, kind="stable")[:k]
        out[d] = value[order], basis @ inner[:, order]
    return out


# ------------------------------------------------------------ projection

def _centred(m: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: long, or whole numbers of any size."""
    top = max(float(np.abs(m).max(initial=0)) * n, max(abs(s) for s in total))
    if top < 2.0**61:
        return n * m - np.array(total, dtype=np.int64)
    return n * m.astype(object) - np.array(total, dtype=object)


def _whitened(c: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (c.astype(float) / n) @ (vectors / np.sqrt(values))


def _deviation(c: np.ndarray) -> np.ndarray:
    top = float(np.abs(c).max(initial=0))
    if c.dtype != object and top * top * c.shape[1] < 2.0**62:
        return (c * c).sum(1)
    c = c.astype(object)
    return np.array([min(int(s), 2**63 - 1) for s in (c * c).sum(1)], dtype=np.int64)


def identity_errors(fit: DataFrame, stats, parts) -> dict[int, float]:
    """{dim: largest absolute entry of the whitened fit list's covariance minus the identity}."""

    def run(batches):
        sums_: dict[int, np.ndarray] = {}
        for dim, m in _by_dim(batches):
            if dim in parts:
                # the mean of the fit list whitens to zero, so these products are centred
                w = _whitened(_centred(m, *stats[dim]), stats[dim][0], *parts[dim])
                g = (w.T @ w).ravel()
                sums_[dim] = sums_[dim] + g if dim in sums_ else g
        if sums_:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums_), pa.int32()),
                                              pa.array([s.tolist() for s in sums_.values()])], names=["dim", "cells"])

    cells = (fit.select("dim", "x").mapInArrow(run, "dim int, cells array<double>")
             .select("dim", F.posexplode("cells").alias("i", "c")).groupBy("dim", "i").agg(F.sum("c").alias("c")))
    worst: dict[int, float] = {}
    for dim, i, c in cells.toLocalIterator():
        k = len(parts[dim][0])
        off = abs(c / stats[dim][0] - (1.0 if i // k == i % k else 0.0))
        worst[dim] = max(worst.get(dim, 0.0), off)
    return worst


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16,
           scale: float = 64.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row and component."""
    spark = df.sparkSession
    x = whole_vectors(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), "v", scale)
    fit = materialize(x.select("dim", "x").distinct(), "whitening-fit")
    stats = sums(fit)
    if any(d > MAX_DIM for d in stats):
        raise ValueError(f"vectors of more than {MAX_DIM} entries")
    covs = covariances(fit, stats)
    parts = components(spark, covs, k)
    errors = identity_errors(fit, stats, parts)
    explained = {d: parts[d][0] / np.trace(covs[d]) for d in parts}

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in map(int, np.unique(dims)):
                if d not in parts:
                    continue
                mine = b.filter(pa.array(dims == d))
                c = _centred(_matrix(mine.column("x"), d), *stats[d])
                w = _whitened(c, stats[d][0], *parts[d])
                rows, m = w.shape
                yield pa.RecordBatch.from_arrays([
                    mine.column("vec_id").take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * m, stats[d][0], dtype=np.int64)),
                    pa.array(np.repeat(_deviation(c), m)), pa.array(w.ravel()),
                    pa.array(np.tile(explained[d], rows)), pa.array(np.full(rows * m, errors[d]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "dim", "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)

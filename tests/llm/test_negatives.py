"""Hard negatives against brute force over all rows."""

import math

import numpy as np
import pytest

from rankshift.llm import negatives


def brute(rows, every=50, pos=5, neg=3):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(c)) for c in v]))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i and len(w) == len(v))
        for ps, j, _ in [x for x in all_ if x[2] == label][:pos]:
            fit = [x for x in all_ if x[2] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:neg]
            out += [(i, j, r + 1, k, -ps, -s) for r, (s, k, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(i, m, v, "x", 1) for i, m, v in rows],
                               "vec_id long, label int, embedding array<float>, block string, cell int")
    return sorted(tuple(r) for r in negatives.op11(df.repartition(parts)).collect())


def table(seed, n, d, spread=1.0, labels=4, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d))
    x = middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))
    return [(int(i), int(rng.integers(0, labels)), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, d, spread, labels", [(700, 8, 0.2, 4), (900, 9, 1.0, 10), (400, 1, 1.0, 2), (300, 16, 0.0, 3)])
def test_equals_brute_force(spark, monkeypatch, n, d, spread, labels):
    # small blocks and cells, so that anchors, shards and cells are many and the floors cut
    for name, size in (("SHARD", 64), ("ANCHORS", 5), ("GROUP", 4), ("SEED", 40), ("CELL_ROWS", 8), ("CHUNK", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = table(n, n, d, spread, labels)
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    from pyspark.sql import functions as F
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df.withColumn("label", moved), shard=64)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert want


def test_odd_rows(spark):
    rows = table(1, 120, 4)
    rows += [(200, None, [1.0] * 4), (250, 1, None), (300, 1, [None] * 4), (350, 2, [float("nan")] * 4),
             (400, 2, [float("inf"), 0.0, 0.0, 0.0]), (450, 2, []), (None, 2, [1.0] * 4), (500, 1, [1.0, 2.0]),
             (501, 1, [1.0, 2.0]), (502, 2, [1.0, 1.5]), (550, 3, [0.0] * 4), (600, 9, [1.0] * 4)]
    rows += [(601, 9, rows[3][2]), (601, 9, rows[3][2]), (650, 1, rows[5][2]), (650, 1, rows[6][2]), (602, -1, [1e8] * 4)]
    assert found(spark, rows) == brute(rows)


def test_wide_and_empty(spark):
    rows = [(i, i % 2, [float(np.float32(x)) for x in v]) for i, v in
            enumerate(np.random.default_rng(2).standard_normal((60, 3)) * 1e5)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(50, 1, [1.0])]) == []


def test_heap_visits_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 6))
    books = negatives.codebook(x[:, :3], 5), negatives.codebook(x[:, 3:], 7)
    (a, r1), (b, r2) = negatives.nearest(x[:, :3], books[0]), negatives.nearest(x[:, 3:], books[1])
    cells = {}
    for i, c in enumerate(zip(a, b)):
        cells.setdefault(c, []).append(i)
    d = negatives.Directory(books, [(i * 7 + j, i * 7 + j, len(m), r1[m].max(), r2[m].max()) for (i, j), m in cells.items()])
    for q in rng.standard_normal((20, 6)):
        bounds, visited = zip(*d.visit(q))
        assert list(bounds) == sorted(bounds, reverse=True) and len(bounds) == 35
        for bound, held in zip(bounds, visited):
            for shard, _, own in held:
                m = cells[divmod(shard, 7)]
                assert (x[m] @ q).max() <= own + 1e-9 and own <= bound + 1e-9
        best = float((x @ q).max())
        assert int(a[(x @ q).argmax()]) * 7 + int(b[(x @ q).argmax()]) in d.certified(q, best)

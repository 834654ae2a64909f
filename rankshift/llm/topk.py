"""Exact top-k inner-product search over integer vectors.

Vectors are ordered by descending length and cut into blocks (range
partitioning on the length).  All vectors are rotated by the eigenvectors of
their Gram matrix (the right singular vectors of the table), so the leading
coordinates carry most of the product.  Queries come in blocks as well.

1. A first pass scores every query against the block of longest vectors; its
   k-th best score is a lower bound of the final k-th score.
2. A pair (query block, vector block) is kept only if the largest length in
   the block times the query length can reach the bound (Cauchy-Schwarz on
   whole vectors).  This is a small join of block headers.
3. Inside a pair, the partial product over the leading rotated coordinates
   plus the product of the residual lengths bounds the score; only pairs of
   rows whose bound reaches the threshold are scored, in exact integers.
   The block is read in descending length, and the k-th best score found so
   far lifts the threshold for the rest of it.
4. Each pair of blocks returns k rows a query; a second top-k merges them.

What goes through the driver: a d x d Gram matrix (d = vector length, at most
``MAX_DIM``) and nothing else.  Nothing is broadcast by hint.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a repeated vec_id is one candidate per row, and a
query never meets rows of its own id; only vectors of the same length meet
(the product of others is undefined); ties go to the smaller vec_id; fewer
than k candidates give fewer rows; scores beyond the long range are clipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankshift.llm.common import materialize

BLOCK = 8192        # vectors in a block
QUERY_BLOCK = 1024  # queries in a block
LEAD = 24           # leading rotated coordinates
CHUNK = 1024        # vectors scored at a time inside a block
DENSE = 32          # one matrix product if at least 1 in so many pairs is wanted
MAX_DIM = 8192


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, dim, len) of the rows that take part."""
    d = df.select(F.col(id_col).cast("long").alias("vec_id"),
                  F.transform(vec_col, lambda x: F.lit(scale) * x.cast("double")).alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    # rounding down by hand: the built-in returns long and would fail on large doubles
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(
        F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x))
    return (d.withColumn("v", whole).withColumn("dim", F.size("v"))
            .withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))))


def _gram(rows: DataFrame) -> dict[int, np.ndarray]:
    """Gram matrix of the vectors by dimension; partial sums per task, then per cell."""

    def partial(frames):
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for dim, part in f.groupby("dim"):
                m = np.stack(part["v"].to_numpy())
                sums[dim] = sums.get(dim, 0.0) + m.T @ m
        if sums:
            yield pd.DataFrame({"dim": list(sums), "g": [g.ravel().tolist() for g in sums.values()]})

    parts = rows.mapInPandas(partial, "dim int, g array<double>")
    cells = parts.select("dim", F.posexplode("g").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x"))
    out = {}
    for dim, g in cells.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("g")).collect():
        out[dim] = np.array([x for _, x in g]).reshape(dim, dim)
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` rows of one dimension in the order of each partition:
    (dim, part, seq, ids, m, longest), m = the vectors row by row as little-endian doubles."""

    def pack(batches):
        seq, rest = 0, {}

        def block(dim, f):
            nonlocal seq
            seq += 1
            return pd.DataFrame({"dim": [dim], "part": [TaskContext.get().partitionId()], "seq": [seq],
                                 "ids": [f["vec_id"].tolist()], "longest": [f["len"].max()],
                                 "m": [np.stack(f["v"].to_numpy()).astype("<f8").tobytes()]})

        for f in batches:
            for dim, part in f.groupby("dim", sort=False):
                part = pd.concat([rest.pop(dim), part]) if dim in rest else part
                for at in range(0, len(part) - size + 1, size):
                    yield block(dim, part.iloc[at:at + size])
                if left := len(part) % size:
                    rest[dim] = part.iloc[len(part) - left:]
        for dim, part in rest.items():
            yield block(dim, part)

    return rows.select("vec_id", "dim", "len", "v").mapInPandas(
        pack, "dim int, part long, seq long, ids array<long>, longest double, m binary")


def _exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (q[i], c[j]), some at a time.  Whole numbers add up exactly in
    doubles below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        x, y = q[i[at:at + step]], c[j[at:at + step]]
        if top < 2.0**53:
            out[at:at + step] = np.einsum("ij,ij->i", x, y)
        else:
            big = (np.vectorize(int, otypes=[object])(x) * np.vectorize(int, otypes=[object])(y)).sum(1)
            out[at:at + step] = [max(-2**63, min(2**63 - 1, n)) for n in big]
    return out


def _cut(i, ids, score, k):
    """The ``k`` best (query row, id, score) of each query row, in that order; ties to the smaller id."""
    order = np.lexsort((ids, ~score, i))  # ~score: descending, also for the smallest long
    i, ids, score = i[order], ids[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[keep], ids[keep], score[keep]


def _reaching(q, c, wanted, floor_, own, k):
    """(query row, row of c, score) of the pairs that can still be among the best ``k``.

    Many wanted pairs: one matrix product over the rows and columns that hold any; few: pair by pair.
    Both are exact (see ``_exact``)."""
    rows, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    n = int(np.count_nonzero(wanted))
    if n * DENSE < len(rows) * len(cols):
        i, j = np.nonzero(wanted & ~own)
        score = _exact(q, c, i, j)
        good = score >= floor_[i]
        return i[good], j[good], score[good]
    score = q[rows] @ c[cols].T
    score[own[np.ix_(rows, cols)]] = -np.inf
    least = floor_[rows]
    if np.count_nonzero(score >= least[:, None]) > 4 * k * len(rows) and len(cols) > k:
        least = np.maximum(least, np.partition(score, len(cols) - k, axis=1)[:, len(cols) - k])
    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    return rows[i], cols[j], score[i, j].astype(np.int64)


def search_block(qid, q, cid, c, floor_, basis, k):
    """Best ``k`` of one pair of blocks: columns query_id, vec_id, score.

    ``floor_``: a score that k candidates of each query are known to reach.  The candidates come longest
    first, ``CHUNK`` at a time, and each chunk lifts the floors for the shorter ones after it."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= 2.0**53
    qr, cr = q @ basis, c @ basis
    qs, cs = np.linalg.norm(qr[:, LEAD:], axis=1), np.linalg.norm(cr[:, LEAD:], axis=1)
    # far above the rounding error of the rotation, far below 1 for usual vectors
    slack = 1e-9 * (1.0 + np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=0))
    floor_ = np.array(floor_, dtype=float)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(c), CHUNK):
        t = slice(at, at + CHUNK)
        own = qid[:, None] == cid[None, t]
        if wide:  # beyond doubles: every pair, in whole numbers
            i, j = np.nonzero(~own)
            found = (i, j, _exact(q, c[t], i, j))
        else:
            wanted = qr[:, :LEAD] @ cr[t, :LEAD].T + np.outer(qs, cs[t]) + slack[:, None] >= floor_[:, None]
            if not wanted.any():
                continue
            found = _reaching(q, c[t], wanted, floor_, own, k)
        i, j, score = found
        best = _cut(*map(np.concatenate, zip(best, (i, cid[t][j], score))), k)
        if not wide:
            full = np.bincount(best[0], minlength=len(qid)) >= k
            last = np.searchsorted(best[0], np.arange(len(qid)), side="right") - 1
            floor_[full] = np.maximum(floor_[full], best[2][last[full]])
    return pd.DataFrame({"query_id": qid[best[0]], "vec_id": best[1], "score": best[2]})


def _scored(pairs: DataFrame, bases: dict[int, np.ndarray], k: int) -> DataFrame:
    def run(frames):
        for f in frames:
            for r in f.itertuples():
                q = np.frombuffer(r.q, "<f8").reshape(-1, r.dim)
                c = np.frombuffer(r.c, "<f8").reshape(-1, r.dim)
                yield search_block(np.asarray(r.q_ids), q, np.asarray(r.c_ids), c,
                                   np.asarray(r.floor, dtype=float), bases[r.dim], k)

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50,
          scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose id is divisible by ``every``."""
    v = materialize(integer_vectors(df, id_col, vec_col, scale), "topk-vectors")
    bases = {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in _gram(v).items()}
    asked = v.where(F.col("vec_id") % every == 0)
    n, n_q = v.count(), asked.count()
    by_length = (v.repartitionByRange(-(-n // block) or 1, "dim", F.desc("len"), "vec_id")
                 .sortWithinPartitions("dim", F.desc("len"), "vec_id"))
    c = materialize(_blocks(by_length, block), "topk-blocks").select(
        "dim", "part", "seq", F.col("ids").alias("c_ids"), F.col("m").alias("c"), "longest")
    q = materialize(_blocks(asked.repartition(-(-n_q // query_block) or 1, "vec_id"), query_block), "topk-queries")
    q = q.select("dim", F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), F.col("ids").alias("q_ids"),
                 F.col("m").alias("q"), F.col("longest").alias("q_len"))

    head = (c.groupBy("dim").agg(F.max(F.struct("longest", "part", "seq")).alias("h"))
            .select("dim", F.col("h.part").alias("part"), F.col("h.seq").alias("seq")))
    low = float(-2**63)
    seed = _scored(q.withColumn("floor", F.transform("q_ids", lambda _: F.lit(low)))
                   .join(c.join(head, ["dim", "part", "seq"]), "dim"), bases, k)
    seed = materialize(_best(seed, k), "topk-seed")
    # the k-th score of the first pass, as a list along the query block
    reach = seed.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("f"))
    known = F.coalesce("f", F.lit(low))
    floors = (q.select("dim", "q_part", "q_seq", "q_len", F.posexplode("q_ids").alias("pos", "id"))
              .join(reach.groupBy("id").agg(F.max("f").alias("f")), "id", "left")
              .groupBy("dim", "q_part", "q_seq").agg(
                  F.transform(F.array_sort(F.collect_list(F.struct("pos", known.alias("f")))),
                              lambda x: x["f"]).alias("floor"),
                  F.min(known).alias("least"), F.max("q_len").alias("q_len")))
    later = c.select("dim", "part", "seq", "longest").join(head, ["dim", "part", "seq"], "left_anti")
    wanted = floors.join(later, "dim").where(F.col("q_len") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    pairs = (wanted.select("dim", "q_part", "q_seq", "part", "seq", "floor")
             .join(q.drop("q_len"), ["dim", "q_part", "q_seq"]).join(c.drop("longest"), ["dim", "part", "seq"]))
    found = _scored(pairs, bases, k).unionByName(seed.drop("rank"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {vectors}
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

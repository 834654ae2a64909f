"""Hard negatives by an inverted multi-index over integer vectors.

The two halves of a vector have a codebook each (k-means on a bounded sample;
every row is indexed).  A pair of codewords is a cell; rows are range
partitioned by cell into shards, so a hot cell spreads over many.  For a row x
in cell (a, b) and an anchor q with halves q1, q2

    q . x <= q1 . a + |q1| r1 + q2 . b + |q2| r2

with r the largest distance of a half from its codeword.  A multi-sequence
heap visits cells by falling sum of the two half bounds (radii included).

The search answers *wants*: the best k rows of the anchor's own label, or of
other labels, with a score in a window [low, high].  It runs twice, for the
positives and then for the negatives of every (anchor, positive):

1. The heap takes cells until they hold ``SEED`` rows; their shards are
   searched.  The k-th score found becomes the floor of the want.
2. The heap runs again and stops at the first cell whose bound is below the
   floors: the window is certified, since no cell after it can hold a better
   row.  Shards of the cells before it are searched; inside a shard cells go
   by falling bound and lift the floors for the rest.
3. The best of all shards are merged.

A shard travels once to each group of at most ``GROUP`` anchors that want it.
The driver holds the codebooks (at most ``MAX_CODES`` words a half) and the
directory of cells: at most ``MAX_CODES``**2 cells plus one entry a shard,
where shards grow with the table so that there are some 100,000 at most.

Defined results: rows with a null id, label or vector, or an empty vector or
one with null or non-finite components take no part; only vectors of one
length meet; a repeated id is one candidate a row, and each anchor row is
answered for itself, without rows of its own id; ties go to the smaller id;
fewer rows than asked for give fewer rows; an empty window (positives with a
negative score) gives none; scores beyond the long range are clipped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankshift.llm.common import materialize

SAMPLE = 16_384      # rows the codebooks are fitted on (an index, checked for completeness by its bounds)
CELL_ROWS = 256      # rows a cell aims at
MAX_CODES = 256      # words of one codebook
LLOYD = 8            # rounds of k-means
SHARD = 8_192        # rows of a shard
SHARDS = 100_000     # beyond so many, shards get larger instead
ANCHORS = 1_024      # anchors of a block
GROUP = 16_384       # anchors that meet one copy of a shard
SEED = 1_024         # rows the first pass looks at
CHUNK = 512          # rows scored at a time
LOW, HIGH = -2**63, 2**63 - 1


def integer_rows(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id, label, v array<double> of whole numbers, dim: the rows that take part."""
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                  F.transform(vec_col, lambda x: F.lit(scale) * x.cast("double")).alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    # floor() of a double is a long; larger doubles are whole already
    small = F.lit(2.0**53)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < small, F.floor(F.least(F.greatest(x, -small), small)).cast("double"))
                        .otherwise(x))
    return d.withColumn("v", whole).withColumn("dim", F.size("v"))


# ------------------------------------------------------------------ index

def codebook(sample: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` words by Lloyd's rounds from the first rows on."""
    words = np.unique(sample[:k], axis=0)
    for _ in range(LLOYD):
        code, _ = nearest(sample, words)
        count = np.bincount(code, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, code, sample)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest word, distance from it) of each row."""
    code = np.concatenate([np.argmin((words * words).sum(1) - 2 * x[at:at + 4096] @ words.T, axis=1)
                           for at in range(0, len(x), 4096)] or [np.zeros(0, int)])
    return code, np.linalg.norm(x - words[code], axis=1)


def codebooks(rows: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dim: the codebooks of both halves}, fitted on some ``SAMPLE`` rows of each length, by a hash of the id."""
    books = {}
    for dim, n in sizes.items():
        k = int(min(MAX_CODES, max(1, round((n / CELL_ROWS) ** 0.5))))
        few = max(k, min(SAMPLE, (64 << 20) // (8 * dim)))
        # a share of all hashes, so nothing is sorted or gathered beyond the sample; ids may repeat, hence the limit
        drawn = F.xxhash64("vec_id") <= int(2.0**63 * min(1.0, 2.0 * few / n - 1.0) * (1 - 2.0**-50))
        m = rows.where((F.col("dim") == dim) & drawn).select("v").limit(2 * few).collect()
        m = np.array([r["v"] for r in m] or [[0.0] * dim])
        books[dim] = codebook(m[:, :dim // 2], k), codebook(m[:, dim // 2:], k)
    return books


def coded(rows: DataFrame, books) -> DataFrame:
    """``rows`` plus cell (number of the codeword pair) and the distances r1, r2 of the halves from their words."""

    def run(frames):
        for f in frames:
            for dim, part in f.groupby("dim", sort=False):
                m = np.stack(part["v"].to_numpy())
                (a, r1), (b, r2) = (nearest(x, w) for x, w in zip((m[:, :dim // 2], m[:, dim // 2:]), books[dim]))
                yield part.assign(cell=a * len(books[dim][1]) + b, r1=r1, r2=r2)

    return rows.mapInPandas(run, "vec_id long, label long, v array<double>, dim int, cell long, r1 double, r2 double")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` rows in the order of each partition, one row each: block, dim, ids, labels, cells,
    m (vectors as little-endian doubles) and the directory (d_cell, d_r1, d_r2, d_n) of its cells."""

    def pack(frames):
        seq, rest = 0, {}

        def block(dim, f):
            nonlocal seq
            seq += 1
            g = f.groupby("cell", sort=False).agg(r1=("r1", "max"), r2=("r2", "max"), n=("r1", "size"))
            return pd.DataFrame({
                "block": [TaskContext.get().partitionId() << 32 | seq], "dim": [dim], "ids": [f["vec_id"].tolist()],
                "labels": [f["label"].tolist()], "cells": [f["cell"].tolist()],
                "m": [np.stack(f["v"].to_numpy()).astype("<f8").tobytes()], "d_cell": [g.index.tolist()],
                "d_r1": [g["r1"].tolist()], "d_r2": [g["r2"].tolist()], "d_n": [g["n"].tolist()]})

        for f in frames:
            for dim, part in f.groupby("dim", sort=False):
                part = pd.concat([rest.pop(dim), part]) if dim in rest else part
                for at in range(0, len(part) - size + 1, size):
                    yield block(dim, part.iloc[at:at + size])
                if left := len(part) % size:
                    rest[dim] = part.iloc[len(part) - left:]
        for dim, part in rest.items():
            yield block(dim, part)

    return rows.mapInPandas(pack, "block long, dim int, ids array<long>, labels array<long>, cells array<long>, m binary, "
                                  "d_cell array<long>, d_r1 array<double>, d_r2 array<double>, d_n array<long>")


class Directory:
    """Cells of one vector length: codebooks, radii by codeword, and the (shard, rows, radii) entries of each cell."""

    def __init__(self, books, entries: list[tuple]):
        self.words = books
        self.radius = [np.zeros(len(w)) for w in books]
        self.cells: dict[tuple[int, int], list[tuple[int, int, float, float]]] = {}
        for cell, shard, n, r1, r2 in entries:
            a, b = divmod(cell, len(books[1]))
            self.radius[0][a], self.radius[1][b] = max(self.radius[0][a], r1), max(self.radius[1][b], r2)
            self.cells.setdefault((a, b), []).append((shard, n, r1, r2))

    def halves(self, q: np.ndarray):
        """Per half: products with the words, length of the half, bound of each word, words by falling bound."""
        at = len(self.words[0][0])
        for x, w, r in zip((q[:at], q[at:]), self.words, self.radius):
            dot, size = w @ x, float(np.linalg.norm(x))
            bound = dot + size * r
            yield dot, size, bound, np.argsort(-bound, kind="stable")

    def visit(self, q: np.ndarray):
        """Multi-sequence heap: (bound of all cells not visited yet, cell, entries with their own bounds)."""
        (d1, s1, u, i_order), (d2, s2, v, j_order) = self.halves(q)
        heap, seen = [(-(u[i_order[0]] + v[j_order[0]]), 0, 0)], {(0, 0)}
        while heap:
            negative, i, j = heapq.heappop(heap)
            a, b = int(i_order[i]), int(j_order[j])
            held = self.cells.get((a, b), ())
            yield -negative, [(shard, n, d1[a] + d2[b] + s1 * r1 + s2 * r2) for shard, n, r1, r2 in held]
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(i_order) and y < len(j_order) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(u[i_order[x]] + v[j_order[y]]), x, y))

    def seeds(self, q: np.ndarray) -> list[int]:
        """Shards of the first cells, ``SEED`` rows or a little more."""
        shards, rows = [], 0
        for _, held in self.visit(q):
            for shard, n, _ in held:
                if rows >= SEED:
                    return shards
                rows += n
                if shard not in shards:
                    shards.append(shard)
        return shards

    def certified(self, q: np.ndarray, floor_: float) -> set[int]:
        """Shards with a row that may score ``floor_`` or more."""
        slack = 1e-9 * (1.0 + abs(floor_) + float(np.linalg.norm(q)) * self.reach)
        shards: set[int] = set()
        for bound, held in self.visit(q):
            if bound + slack < floor_:
                break
            shards.update(shard for shard, _, own in held if not own + slack < floor_)
        return shards

    @property
    def reach(self) -> float:
        """More than the length of any indexed vector."""
        return sum(float((np.linalg.norm(w, axis=1) + r).max(initial=0)) for w, r in zip(self.words, self.radius))


# ------------------------------------------------------------------ search

WANTS = "pos array<int>, slot array<int>, low array<long>, high array<long>"
PLAN = "shard long, block long, dim int, rows array<int>, ids array<long>, labels array<long>, q binary, " + WANTS


def planned(blocks: DataFrame, index: dict[int, Directory], first: bool) -> DataFrame:
    """The anchors of each block that must see a shard, with their wants, one row a (block, shard).

    ``first``: the seed shards; else all other shards up to the certified end of the visit."""

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                if not len(r.pos):
                    continue
                q = np.frombuffer(r.m, "<f8").reshape(-1, r.dim)
                ids, labels = np.asarray(r.ids), np.asarray(r.labels)
                pos, slot, low, high = map(np.asarray, (r.pos, r.slot, r.low, r.high))
                todo: dict[int, list[int]] = {}
                for p in np.unique(pos):
                    shards = index[r.dim].seeds(q[p])
                    if not first:
                        shards = index[r.dim].certified(q[p], float(low[pos == p].min())) - set(shards)
                    for s in shards:
                        todo.setdefault(s, []).append(p)
                for shard, rows in todo.items():
                    rows = np.array(rows)
                    mine = np.isin(pos, rows)
                    yield pd.DataFrame({
                        "shard": [shard], "block": [r.block], "dim": [r.dim], "rows": [rows.tolist()],
                        "ids": [ids[rows].tolist()], "labels": [labels[rows].tolist()], "q": [q[rows].tobytes()],
                        "pos": [np.searchsorted(rows, pos[mine]).tolist()], "slot": [slot[mine].tolist()],
                        "low": [low[mine].tolist()], "high": [high[mine].tolist()]})

    return blocks.select("block", "dim", "ids", "labels", "m", "pos", "slot", "low", "high").mapInPandas(run, PLAN)


def _scores(q: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    """Exact integer products: doubles hold them below 2**53, whole numbers of any size beyond (clipped to long)."""
    if not wide:
        return (q @ c.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    return np.clip(big(q) @ big(c).T, LOW, HIGH).astype(np.int64)


def _cut(want, ids, score, k):
    """The ``k`` best of each want, best first; ties to the smaller id."""
    order = np.lexsort((ids, ~score, want))  # ~: descending, also for the smallest long
    want, ids, score = want[order], ids[order], score[order]
    keep = np.arange(len(want)) - np.searchsorted(want, want, side="left") < k
    return want[keep], ids[keep], score[keep]


class Shard:
    """One shard ready to be searched: its rows by cell."""

    def __init__(self, row, books):
        self.m = np.frombuffer(row.m, "<f8").reshape(-1, row.dim)
        self.ids, self.labels = np.asarray(row.ids), np.asarray(row.labels)
        cells, d_cell = np.asarray(row.cells), np.asarray(row.d_cell)
        a, b = np.divmod(d_cell, len(books[1]))
        self.words = books[0][a], books[1][b]
        self.radii = np.asarray(row.d_r1), np.asarray(row.d_r2)
        at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])  # rows are sorted by cell
        self.runs = list(zip(at, np.r_[at[1:], len(cells)]))
        self.top = float(np.abs(self.m).max(initial=0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each anchor's score in each cell."""
        half = q.shape[1] // 2
        total = 1e-9 * (1.0 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(self.m, axis=1).max(initial=0))
        for x, w, r in zip((q[:, :half], q[:, half:]), self.words, self.radii):
            total = total + x @ w.T + np.outer(np.linalg.norm(x, axis=1), r)
        return total

    def search(self, q, own_id, own_label, row, low, high, same: bool, k: int):
        """Best ``k`` rows of each want: (want number, id, score).  ``row``: the anchor of the want."""
        wide = float(np.abs(q).max(initial=0)) * self.top * q.shape[1] >= 2.0**53
        floor_ = np.array(low, dtype=np.int64)
        bound = np.full((len(q), len(self.runs)), np.inf) if wide else self.bounds(q)
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for cell in np.argsort(-bound.max(axis=0), kind="stable"):
            start, stop = self.runs[cell]
            for at in range(start, stop, CHUNK):
                t = slice(at, min(stop, at + CHUNK))
                live = np.flatnonzero(~(bound[row, cell] < floor_))
                if not len(live):
                    break
                anchors, place = np.unique(row[live], return_inverse=True)
                score = _scores(q[anchors], self.m[t], wide)
                fits = (own_label[anchors][:, None] == self.labels[None, t]) == same
                fits &= own_id[anchors][:, None] != self.ids[None, t]
                s = score[place]
                w, j = np.nonzero(fits[place] & (s >= floor_[live][:, None]) & (s <= high[live][:, None]))
                if not len(w):
                    continue
                best = _cut(*map(np.concatenate, zip(best, (live[w], self.ids[t][j], s[w, j]))), k)
                full = np.bincount(best[0], minlength=len(row)) >= k
                last = np.searchsorted(best[0], np.arange(len(row)), side="right") - 1
                floor_[full] = np.maximum(floor_[full], best[2][last[full]])
        return best


FOUND = "block long, pos int, slot int, anchor_id long, vec_id long, score long"


def searched(plan: DataFrame, shards: DataFrame, books, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of each shard for each planned want."""
    plan = materialize(plan, "negatives-plan")
    load = plan.groupBy("shard").agg(F.ceil(F.sum(F.size("rows")) / GROUP).cast("int").alias("groups"))
    busy = {r["shard"]: r["groups"] for r in load.where("groups > 1").toLocalIterator()}  # at most one entry a shard
    right = shards.withColumnsRenamed({"block": "shard"})
    groups, copies = F.lit(1), F.array(F.lit(0))
    if busy:  # a shard that many anchors want is copied once for every GROUP of them
        sizes = plan.sparkSession.createDataFrame(list(busy.items()), "shard long, groups int")
        plan, right = plan.join(sizes, "shard", "left"), right.join(sizes, "shard", "left")
        groups = F.coalesce("groups", F.lit(1))
        copies = F.sequence(F.lit(0), groups - 1)
    left = (plan.withColumn("part", F.pmod(F.xxhash64("block"), groups).cast("int"))
            .select("shard", "part", "block", "dim", "rows", "ids", "labels", "q", "pos", "slot", "low", "high"))
    right = right.withColumn("copy", F.explode(copies)).select(
        "shard", "copy", "dim", "ids", "labels", "cells", "m", "d_cell", "d_r1", "d_r2")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:  # ``asked`` is empty for a shard nobody wants
        out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("block", "pos", "slot", "anchor_id", "vec_id", "score")})]
        for h in held.itertuples() if len(asked) else ():
            shard = Shard(h, books[h.dim])
            for r in asked.itertuples():
                ids, row, slot = np.asarray(r.ids), np.asarray(r.pos), np.asarray(r.slot)
                want, found, score = shard.search(np.frombuffer(r.q, "<f8").reshape(-1, r.dim), ids, np.asarray(r.labels), row,
                                                  np.asarray(r.low), np.asarray(r.high), same, k)
                out.append(pd.DataFrame({"block": r.block, "pos": np.asarray(r.rows)[row[want]], "slot": slot[want],
                                         "anchor_id": ids[row[want]], "vec_id": found, "score": score}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "copy")).applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "pos", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_wants(blocks: DataFrame, wants: DataFrame) -> DataFrame:
    """``blocks`` plus the wants (block, pos, slot, low, high) of their anchors as parallel arrays."""
    lists = wants.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "slot", "low", "high"))).alias("w"))
    return blocks.join(lists, "block").select(
        *blocks.columns, *(F.col(f"w.{c}").alias(c) for c in ("pos", "slot", "low", "high")))


def answered(blocks: DataFrame, shards: DataFrame, index, books, wants: DataFrame, same: bool, k: int) -> DataFrame:
    """FOUND columns and rank: the best ``k`` rows of every want (block, pos, slot, low, high)."""
    wants = wants.where("low <= high")
    seed = materialize(_best(searched(planned(_with_wants(blocks, wants), index, True), shards, books, same, k), k),
                       "negatives-seed")
    known = seed.where(F.col("rank") == k).select("block", "pos", "slot", F.col("score").alias("floor"))
    lifted = wants.join(known, ["block", "pos", "slot"], "left").select(
        "block", "pos", "slot", F.greatest("low", "floor").alias("low"), "high")  # greatest() skips nulls
    rest = searched(planned(_with_wants(blocks, lifted), index, False), shards, books, same, k)
    return materialize(_best(rest.unionByName(seed.drop("rank")), k), "negatives-found")


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   every: int = 50, positives: int = 5, negatives: int = 3, scale: float = 256.0,
                   shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: ids divisible by ``every``.  For each of an anchor's best ``positives`` rows of its label: the best
    ``negatives`` rows of other labels that score from 50 % to 95 % of the positive."""
    rows = integer_rows(df, id_col, label_col, vec_col, scale)
    sizes = {d: n for d, n in rows.groupBy("dim").count().collect()}
    n = sum(sizes.values())
    books = codebooks(rows, sizes)
    rows = materialize(coded(rows, books), "negatives-rows")
    shard = max(shard, -(-n // SHARDS))

    def in_blocks(part: DataFrame, count: int, size: int, name: str) -> DataFrame:
        order = ("dim", "cell", "vec_id")
        by_cell = part.repartitionByRange(-(-count // size) or 1, *order).sortWithinPartitions(*order)
        return materialize(packed(by_cell, size), name)

    asked = rows.where(F.col("vec_id") % every == 0)
    shards = in_blocks(rows, n, shard, "negatives-shards")
    blocks = in_blocks(asked, asked.count(), ANCHORS, "negatives-anchors").select("block", "dim", "ids", "labels", "m")
    entries: dict[int, list] = {d: [] for d in sizes}
    for r in shards.select("block", "dim", F.arrays_zip("d_cell", "d_n", "d_r1", "d_r2").alias("d")).toLocalIterator():
        entries[r["dim"]] += [(cell, r["block"], m, r1, r2) for cell, m, r1, r2 in r["d"]]
    index = {d: Directory(books[d], e) for d, e in entries.items()}

    every_row = blocks.select("block", F.posexplode("ids").alias("pos", "id")).select(
        "block", "pos", F.lit(0).alias("slot"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    near = answered(blocks, shards, index, books, every_row, True, positives)
    # 50 p <= 100 s <= 95 p in whole numbers, inside the long range: ceil(p / 2) <= s <= p - ceil(p / 20); none if p < 0
    p = F.col("score")
    windows = near.where(p >= 0).select(
        "block", "pos", F.col("rank").alias("slot"), (p - F.shiftright(p, 1)).alias("low"),
        (p - F.expr("score div 20") - (p % 20 > 0).cast("long")).alias("high"))
    far = answered(blocks, shards, index, books, windows, False, negatives)
    pairs = near.select("block", "pos", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return far.join(pairs, ["block", "pos", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op11(vectors: DataFrame) -> DataFrame:
    """Every id divisible by 7 first gets the next label of ten."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM {vectors} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER (ORDER BY vec_id, label, v) AS a FROM r WHERE vec_id % 50 = 0),
s AS (SELECT a.a, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM a JOIN r c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS pr FROM s WHERE same)
      WHERE pr <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
             s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.pr ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score::HUGEINT <= 100 * s.score::HUGEINT
                   AND 100 * s.score::HUGEINT <= 95 * p.score::HUGEINT)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""Quality classifier: random-indexing word vectors, pooled, then a small network.

1. Random indexing: a word has a sparse ternary index vector drawn from its
   hash (``DIMS`` numbers, ``NONZERO`` of them +-1).  The context vector of a
   word is the sum of the index vectors of its neighbours (``REACH`` to both
   sides) over the training sample.  Words are hashed to ``ROWS`` rows, so
   the table of context vectors has a fixed size.
2. A document is the mean over all its words of the word's own index vector
   and of its normalised context vector, together with the share of each
   word shape (case, digits, marks), which random indexing sees as words of
   their own.
3. A two-layer network (``HIDDEN`` tanh units) in numpy, trained by Adam on
   pooled vectors of at most ``SAMPLE`` labelled rows (smallest hash of the
   id); a fifth of them is kept to fit the temperature of the probabilities.

Words are runs of non-space characters.  A null or empty text has the zero
vector and gets the network's answer for it.  Without training rows of both
classes every score is 0.5.  Repeated rows score alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankshift.llm.common import add_columns, doc_crc, materialize, pick_sample

SAMPLE = 12_000
DIMS = 48
NONZERO = 6
ROWS = 1 << 14
REACH = 2
HIDDEN = 32


def _shape(word: str) -> str:
    """Word shape: runs of upper, lower, digit, or the mark itself."""
    out = []
    for c in word[:64]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def index_table() -> np.ndarray:
    """(ROWS x DIMS) ternary index vectors, drawn from the row number only."""
    rng = np.random.default_rng(20_011)
    at = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    table = np.zeros((ROWS, DIMS), np.float32)
    np.put_along_axis(table, at, rng.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO)), axis=1)
    return table


class Words:
    """Row numbers of the words of a text; remembers words it has met (emptied when full)."""

    def __init__(self, room: int = 300_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.room = room

    def rows(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        known = self.known
        if len(known) > self.room:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (zlib.crc32(w.lower().encode()) % ROWS, zlib.crc32(b"\0" + _shape(w).encode()) % ROWS)
        both = np.array([known[w] for w in words], dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _context(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the neighbours of each position."""
    v = index[rows]
    out = np.zeros_like(v)
    for d in range(1, REACH + 1):
        out[d:] += v[:-d]
        out[:-d] += v[d:]
    return out


def context_table(rows: DataFrame) -> np.ndarray:
    """Normalised context vectors by word row, summed over the texts of ``rows``."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def count(batches):
        index, words = index_table(), Words()
        sums = np.zeros((ROWS, DIMS))
        for b in batches:
            for t in b.column("text").to_pylist():
                own, shape = words.rows(t)
                for r in (own, shape):
                    for at in range(0, len(r), 1 << 14):
                        part = r[at:at + (1 << 14)]
                        if len(part):
                            order = np.argsort(part, kind="stable")
                            start = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
                            sums[part[order][start]] += np.add.reduceat(_context(part, index)[order], start)
        used = np.flatnonzero(np.abs(sums).sum(1))
        for at in range(0, len(used), 2048):
            some = used[at:at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64()))],
                                             names=["row", "v"])

    parts = rows.select("text").mapInArrow(count, schema)
    cells = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)]
    table = np.zeros((ROWS, DIMS), np.float32)
    got = parts.groupBy("row").agg(*cells).toPandas()  # at most ROWS rows
    if len(got):
        v = got.drop(columns="row").to_numpy(dtype=float)
        table[got["row"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return table


def pooled(text: str | None, words: Words, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    own, shape = words.rows(text)
    if not len(own):
        return np.zeros(4 * DIMS)
    # counts first: a long text costs one row sum, not one vector a word
    n_own, n_shape = (np.bincount(r, minlength=ROWS) for r in (own, shape))
    a, b = np.flatnonzero(n_own), np.flatnonzero(n_shape)
    wa, wb = n_own[a] / len(own), n_shape[b] / len(own)
    return np.concatenate([wa @ index[a], wa @ context[a], 2.0 * (wb @ index[b]), wb @ context[b]])


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> dict:
    """Two-layer network with a temperature; classes weigh alike in the loss."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, own = order[:cut], order[cut:]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - mean) / scale
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
         "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    share = min(max(y[own].mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    t = 0
    for _ in range(epochs):
        for at in range(0, len(own), 128):
            i = own[at:at + 128] if _ == 0 else rng.choice(own, min(128, len(own)), replace=False)
            h = np.tanh(z[i] @ p["a"] + p["b"])
            g = (1 / (1 + np.exp(-np.clip(h @ p["c"] + p["d"], -30, 30))) - y[i]) * weight[i] / len(i)
            back = np.outer(g, p["c"]) * (1 - h * h)
            grads = {"a": z[i].T @ back + 1e-4 * p["a"], "b": back.sum(0), "c": h.T @ g + 1e-4 * p["c"], "d": g.sum(keepdims=True)}
            t += 1
            for k, v in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[held] @ p["a"] + p["b"]) @ p["c"] + p["d"]
    temps = np.geomspace(0.25, 8.0, 41)
    prob = 1 / (1 + np.exp(-np.clip(logit[:, None] / temps, -30, 30)))
    loss = -(weight[held, None] * np.where(y[held, None] == 1, np.log(prob + 1e-12), np.log(1 - prob + 1e-12))).mean(0)
    return {**p, "mean": mean, "scale": scale, "temperature": float(temps[int(np.argmin(loss))])}


def network(net: dict, x: np.ndarray) -> np.ndarray:
    logit = np.tanh((x - net["mean"]) / net["scale"] @ net["a"] + net["b"]) @ net["c"] + net["d"]
    return 1 / (1 + np.exp(-np.clip(logit / net["temperature"], -30, 30)))


def train(labelled: DataFrame, sample: int = SAMPLE, label: str = "quality") -> dict:
    """Model from rows (doc_id, text, label 0/1)."""
    ids = pick_sample(labelled.select("doc_id"), "doc_id", sample)
    rows = labelled.join(materialize(ids, "quality-sample").distinct(), "doc_id", "left_semi")
    rows = materialize(rows.select("doc_id", "text", F.col(label).alias("y")), "quality-rows")
    context = context_table(rows)

    def make():
        words, index = Words(), index_table()
        return lambda texts: [[pooled(t, words, index, context).tolist() for t in texts]]

    got = add_columns(rows, make, [("x", "array<double>")]).select("y", "x").toPandas()  # at most ``sample`` rows
    y = got["y"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return {"net": None, "context": context}
    return {"net": fit(np.stack(got["x"].to_numpy()), y), "context": context}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    def make():
        words, index, net, context = Words(), index_table(), model["net"], model["context"]

        def f(texts):
            if net is None:
                return [[0.5] * len(texts)]
            x = np.array([pooled(t, words, index, context) for t in texts])
            return [network(net, x).tolist()]
        return f

    return add_columns(docs, make, [(out, "double")], text)


def held_out(doc_id):
    return doc_crc(doc_id, 4) == 2


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    y = (labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    model = train(docs.select("doc_id", "text").join(y, "doc_id"))
    r = score(docs.select("doc_id", "text"), model)
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.7).cast("int").alias("predicted"))

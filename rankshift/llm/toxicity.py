"""Toxicity by maximum-scoring segments of token log-odds.

1. Counts of each unit in both classes over a training sample (at most
   ``SAMPLE`` labelled rows, the ones with the smallest hash of the id; equal
   texts count once, and a text counts a unit ``MOST`` times at most).  Units
   are words and their first 3 to 8 letters, so inflected and compound forms of
   a rare word support each other.
2. Log-odds of each unit with an informative Dirichlet prior (``PRIOR`` times
   its count in both classes together), shrunk towards 0 by ``DOUBT`` standard
   errors; what is left of units that are surer than that is their weight.  A
   token takes the largest weight (by size) of its units, or ``-DRIFT`` if none
   has any.  A clean text therefore drifts down, as segment statistics need.
3. A linear-time scan (Ruzzo and Tompa) finds all maximal-scoring segments of
   the whole text; these are the candidate passages.
4. Extreme-value calibration: best segment scores of clean training texts
   follow a Gumbel law whose place grows with the log of the text length
   (Karlin and Altschul).  Its two parameters are fitted by moments.  Passages
   whose tail probability is below ``ALPHA`` are significant.  The document
   statistic adds up ``-log`` of the tail probability of the best and of the
   significant passages; a logistic curve fitted on the training rows maps
   it to 0..1.  Law and curve are cross-fitted: every training row is scanned
   with weights that the other ``FOLDS - 1`` parts of the sample gave.

Tokens are runs of letters, lower-cased.  Score of a null or empty text, or
of a text without letters: the calibrated score of "no passage".  Without
training rows of both classes every score is 0.  Repeated rows score alike.

Defined results further: an empty table gives no rows; very long texts are
scanned whole in linear time; input columns named like an output column are
replaced.

What reaches the driver comes from the bounded sample and does not grow with
the input: the units with a weight (the ``MAX_TOKENS`` surest of each fold) and
three numbers a training row.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankshift.llm.common import add_columns, doc_crc, materialize, pick_sample

SAMPLE = 20_000
MOST = 10
PRIOR = 0.05
DOUBT = 3.0
DRIFT = 0.1
ALPHA = 0.01
FOLDS = 2
MAX_TOKENS = 50_000
ROOM = 200_000       # entries of a task's tables of words and units before they are handed on or emptied
HEADS = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in HEADS if len(word) >= n)]


class Weights:
    """Token weights under a unit table {unit: weight}; remembers tokens it has met (emptied when full)."""

    def __init__(self, table: dict, room: int = ROOM):
        self.table, self.room, self.known = table, room, {}

    def __call__(self, toks: list[str]) -> np.ndarray:
        if len(self.known) > self.room:
            self.known.clear()
        for w in set(toks).difference(self.known):
            got = [self.table[u] for u in units(w) if u in self.table]
            self.known[w] = max(got, key=abs) if got else -DRIFT
        return np.fromiter(map(self.known.__getitem__, toks), float, len(toks))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time."""
    sums = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    # each entry: start, end, sum before it, sum up to its end
    stack: list[tuple] = []
    for i, total, s in zip(at.tolist(), sums[at].tolist(), scores[at].tolist()):
        new = (i, i + 1, total - s, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, fold, y1, y0): how often each unit counts in both classes, added up text by text inside the tasks."""

    def run(frames):
        import pandas as pd

        sums: dict[tuple, list[int]] = {}

        def part():
            return pd.DataFrame([(u, f, *n) for (u, f), n in sums.items()], columns=["unit", "fold", "y1", "y0"])

        for frame in frames:
            for text, toxic, fold in zip(frame["text"], frame["toxic"], frame["fold"]):
                found = collections.Counter()
                for w, n in collections.Counter(tokens(text)).items():
                    for u in units(w):
                        found[u] += n
                for u, n in found.items():
                    sums.setdefault((u, fold), [0, 0])[0 if toxic == 1 else 1] += min(n, MOST)
                if len(sums) > ROOM:
                    yield part()
                    sums.clear()
        yield part()

    return rows.mapInPandas(run, "unit string, fold int, y1 long, y0 long")


def log_odds(rows: DataFrame) -> DataFrame:
    """(part, unit, weight, z) from ``rows`` (text, toxic 0/1, fold): the weights that all folds but ``part`` give;
    ``part`` = ``FOLDS`` leaves none out.  Units without a weight are left out."""
    t = unit_counts(rows).groupBy("unit", "fold").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda p: p != F.col("fold"))
    t = (t.withColumn("part", F.explode(others)).groupBy("part", "unit")
         .agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    t = materialize(t, "toxicity-counts")
    all_ = t.groupBy("part").agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"))  # FOLDS + 1 rows
    t = t.join(F.broadcast(all_), "part").where("n1 > 0 and n0 > 0")
    a, total = PRIOR * (F.col("y1") + F.col("y0")), PRIOR * (F.col("n1") + F.col("n0"))
    w = (F.log((F.col("y1") + a) / (F.col("n1") + total - F.col("y1") - a))
         - F.log((F.col("y0") + a) / (F.col("n0") + total - F.col("y0") - a)))
    err = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    t = t.select("part", "unit", w.alias("w"), err.alias("err")).where(F.abs("w") > DOUBT * F.col("err"))
    return t.select("part", "unit", (F.signum("w") * (F.abs("w") - DOUBT * F.col("err"))).alias("weight"),
                    (F.abs("w") / F.col("err")).alias("z"))


def _tail(best, n, law):
    """-log of the chance that a clean text of ``n`` tokens reaches ``best``."""
    place, scale = law
    x = np.minimum((place + scale * np.log(np.maximum(n, 1.0)) - best) / scale, 50.0)
    return -np.log(-np.expm1(-np.exp(x)) + 1e-300)


def _fit_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Gumbel place and scale of ``best - scale log n`` by moments."""
    scale = 1.0
    for _ in range(20):
        rest = best - scale * np.log(np.maximum(n, 1.0))
        scale = max(0.05, 0.5 * scale + 0.5 * float(rest.std()) * math.sqrt(6) / math.pi)
    rest = best - scale * np.log(np.maximum(n, 1.0))
    return float(rest.mean()) - 0.57722 * scale, scale


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps with a small ridge)."""
    b = np.zeros(2)
    f = np.stack([np.minimum(x, 60.0), np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
        grad = f.T @ (p - y) + 1e-2 * b
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -2, 2)
    return max(float(b[0]), 0.0), float(b[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from texts (doc_id, text) and labels (doc_id, toxic 0/1, one row an id).

    The sample is drawn from the labels, so only its texts leave their tasks; its
    ids (at most ``sample`` rows) are broadcast."""
    ids = materialize(pick_sample(labels.select("doc_id", "toxic"), "doc_id", sample), "toxicity-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["text"])
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "toxicity-rows")
    order = Window.partitionBy("part").orderBy(F.desc("z"), "unit")
    surest = log_odds(rows).withColumn("r", F.row_number().over(order)).where(F.col("r") <= MAX_TOKENS)
    tables: list[dict] = [{} for _ in range(FOLDS + 1)]
    for r in surest.select("part", "unit", "weight").collect():
        tables[r["part"]][r["unit"]] = float(r["weight"])
    model = {"table": tables[FOLDS], "law": (0.0, 1.0), "curve": None}
    found = _scanned(rows, tables, None).collect()
    y = np.array([r["toxic"] for r in found], dtype=float)
    if not model["table"] or len(set(y)) < 2:
        return model
    best, n = (np.array([r[c] for r in found], dtype=float) for c in ("best", "n_tok"))
    model["law"] = _fit_law(best[y == 0], n[y == 0])
    found = _scanned(rows, tables, model["law"]).collect()
    model["curve"] = _fit_curve(np.array([r["best"] for r in found]), np.array([r["toxic"] for r in found], dtype=float))
    return model


def _scanned(rows: DataFrame, tables: list[dict], law) -> DataFrame:
    """(toxic, best, n_tok) of training rows under the weights of the other folds: the best passage score, or with a
    ``law`` the document statistic."""

    def run(batches):
        import pyarrow as pa

        weigh = [Weights(t) for t in tables]
        for b in batches:
            out = []
            for t, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist()):
                toks = tokens(t)
                scores = [s for _, _, s in segments(weigh[fold](toks))]
                out.append((max(scores, default=0.0) if law is None else _statistic(scores, len(toks), law)[0], len(toks)))
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([x for x, _ in out], pa.float64()),
                                              pa.array([n for _, n in out], pa.int64())], names=["toxic", "best", "n_tok"])

    return rows.mapInArrow(run, "toxic int, best double, n_tok long")


def _statistic(scores: list[float], n: int, law) -> tuple[float, list[bool]]:
    """Document statistic and which passages are significant."""
    if not len(scores):
        return float(_tail(0.0, float(n), law)), []
    tail = np.minimum(_tail(np.asarray(scores, dtype=float), float(n), law), 60.0)
    kept = tail >= -math.log(ALPHA)
    best = int(np.argmax(tail))
    rest = kept.copy()
    rest[best] = False
    return float(tail[best] + tail[rest].sum()), kept.tolist()


def score(docs: DataFrame, model: dict, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus score, n_passages (significant ones) and passages (start:end in words)."""

    def make():
        weigh = Weights(model["table"])

        def one(t):
            if model["curve"] is None:
                return 0.0, 0, ""
            toks = tokens(t)
            found = segments(weigh(toks))
            stat, kept = _statistic([s for _, _, s in found], len(toks), model["law"])
            a, b = model["curve"]
            z = max(-30.0, min(30.0, a * min(stat, 60.0) + b))
            places = [f"{i}:{j}" for (i, j, _), k in zip(found, kept) if k]
            return 1 / (1 + math.exp(-z)), len(places), ",".join(places)

        return lambda texts: list(map(list, zip(*[one(t) for t in texts])))

    names = [(prefix + "score", "double"), (prefix + "n_passages", "long"), (prefix + "passages", "string")]
    return add_columns(docs.drop(*(n for n, _ in names)), make, names, text)


def held_out(doc_id):
    return doc_crc(doc_id, 3) == 1


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    y = (labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    model = train(docs, y)
    r = score(docs.select("doc_id", "text"), model)
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary n-gram classifier a bit predicts
that bit.  Decoding is loss-weighted: the language whose codeword has the
smallest sum of log losses over all bits, and a text is flagged as ambiguous
when the runner-up is almost as near.

* Features: letter n-grams (1 to 3, with word borders) hashed to ``BUCKETS``.
  Letters are the characters of category L: numbers such as half, superscript
  or Roman numeral signs are none.
* A bit's classifier is a naive Bayes log-odds of the hashed n-grams of the
  languages whose codeword has the bit, against the others, with Dirichlet
  smoothing; its margin is divided by the root of the n-gram count, so long
  texts do not saturate.  The n-gram counts by language come from one
  distributed aggregation over at most ``SAMPLE`` training rows of each
  language (the smallest hashes of id and text, among texts with a letter), so
  a rare language is learned whatever its share.  What reaches the driver is a
  table of (languages x BUCKETS) counts, whose size does not grow with the
  input; at most ``MAX_LANGS`` languages (an error says so beyond that).
* Codewords: for up to 5 languages all distinct two-way splits, else
  hash-drawn balanced words of ``max(15, 10 log2 L)`` bits.

Defined results: ``und`` (score 0) if the text is null or has no letter, or
if there is nothing to learn from.  Ties between languages go to the first
by name.  Every input row gives one row; rows with a null ``lang`` are not
learned from.
"""

from __future__ import annotations

import math

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankshift.llm.common import add_columns, doc_crc, materialize

BUCKETS = 1 << 14
SAMPLE = 2_000       # training rows of a language
MAX_LANGS = 1_000
_LETTERS = regex.compile(r"\p{L}+")


def gram_ids(text: str) -> np.ndarray:
    """Hashed letter n-grams (1-3) of the whole text; words are bordered by blanks."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - 14)
    one = c
    two = c[:-1] * np.uint64(1 << 21) + c[1:]
    three = two[:-1] * np.uint64(1 << 21) + c[2:]
    ids = [((g + np.uint64(n)) * mult >> shift) for n, g in ((1, one), (2, two), (3, three))]
    return np.concatenate(ids).astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """(languages x bits) of -1 / 1; every bit splits the languages, all words differ."""
    if languages <= 1:
        return np.ones((languages, 1), np.int64)
    if languages <= 5:
        splits = [[1 if i == languages - 1 else -1 if (s >> i) & 1 else 1 for i in range(languages)]
                  for s in range(1, 1 << (languages - 1))]
        return np.array(splits).T
    bits = max(15, math.ceil(10 * math.log2(languages)))
    rng = np.random.default_rng(languages)  # fixed by the number of languages
    best, best_gap = None, -1
    for _ in range(20):
        half = np.resize([1, -1], languages)
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        far = (bits - code @ code.T) // 2 + np.eye(languages, dtype=np.int64) * bits
        if far.min() > best_gap:
            best, best_gap = code, far.min()
    return best


def train(labelled: DataFrame, sample: int = SAMPLE, lang: str = "lang", text: str = "text",
          key: str = "doc_id") -> dict:
    """Model from rows with a language and a letter: at most ``sample`` of each language, by the smallest hash of
    the key, so a rare language is learned from all its rows.  Counts are summed in the tasks; see the module text."""
    texts = labelled.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    texts = texts.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    texts = texts.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.xxhash64("t")))
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # a share of all hashes that holds some 1.5 times the sample, then the smallest of it exactly
    bounds = [(r["lang"], int(2.0**63 * min(1.0, 3.0 * sample / r["n"] - 1.0) * (1 - 2.0**-50))) for r in sizes]
    bounds = labelled.sparkSession.createDataFrame(bounds, "lang string, most long")  # at most MAX_LANGS rows
    rows = texts.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("most"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    rows = materialize(rows.withColumn("r", first).where(F.col("r") <= sample).select("lang", "t"), "language-sample")

    def count(frames):
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for name, t in zip(f["lang"], f["t"]):
                if t:
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(gram_ids(t), minlength=BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": name, "id": at, "c": c[at]})

    counts = rows.select("lang", "t").mapInPandas(count, "lang string, id long, c long")
    counts = counts.groupBy("lang", "id").agg(F.sum("c").alias("c"))
    per_lang = (counts.groupBy("lang").agg(F.collect_list(F.struct("id", "c")).alias("cells"))  # at most BUCKETS cells
                .orderBy("lang").collect())  # at most MAX_LANGS rows
    names = [r["lang"] for r in per_lang]
    table = np.zeros((len(names), BUCKETS))
    for i, r in enumerate(per_lang):
        cells = np.array(r["cells"], dtype=np.int64).reshape(-1, 2)
        table[i, cells[:, 0]] = cells[:, 1]
    if not names:
        return {"names": [], "code": codewords(0), "weights": np.zeros((BUCKETS, 0), np.float32)}
    code = codewords(len(names))
    rate = (table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * BUCKETS)  # every language weighs the same
    pos = ((code == 1).T @ rate) / np.maximum((code == 1).sum(0), 1)[:, None]
    neg = ((code == -1).T @ rate) / np.maximum((code == -1).sum(0), 1)[:, None]
    weights = np.where(((code == 1).any(0) & (code == -1).any(0))[:, None],
                       np.log(np.maximum(pos, 1e-12)) - np.log(np.maximum(neg, 1e-12)), 1.0)
    return {"names": names, "code": code, "weights": weights.T.astype(np.float32).copy()}


def predict(model: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of one text."""
    ids = gram_ids(text) if text else ()
    if not len(ids) or not model["names"]:
        return "und", 0.0, False
    margin = np.zeros(model["weights"].shape[1])
    for at in range(0, len(ids), 1 << 15):
        margin += model["weights"][ids[at:at + (1 << 15)]].sum(0, dtype=np.float64)
    margin /= math.sqrt(len(ids))
    # loss-weighted decoding: the log loss of each bit under each codeword
    loss = np.logaddexp(0.0, -model["code"] * margin).sum(1)
    odds = np.exp(loss.min() - loss)
    odds /= odds.sum()
    best = int(np.argmin(loss))
    second = float(np.partition(odds, -2)[-2]) if len(odds) > 1 else 0.0
    return model["names"][best], float(odds[best]), bool(odds[best] - second < 0.1)


def identify(docs: DataFrame, model: dict, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus lang_pred, score and ambiguous.  The model (a fixed-size table) travels with the task."""

    def make():
        return lambda texts: list(map(list, zip(*[predict(model, t) for t in texts])))

    return add_columns(docs, make, [(prefix + "lang_pred", "string"), (prefix + "score", "double"),
                                    (prefix + "ambiguous", "boolean")], text)


def held_out(doc_id):
    return doc_crc(doc_id, 4) == 2


def op8(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    r = identify(docs.select("doc_id", "text"), model)
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

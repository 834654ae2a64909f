"""Rank metrics over fake positions, BLEU, length histograms, run tables.

All metrics are ``groupBy().agg()`` passes with partial aggregation; the
driver only ever sees one small row per ranker/run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.functions.text import with_term_counts, word_tokens
from rankshift.operators.stats import exact_percentile

DEFAULT_KS = (1, 3, 5)

# The published names of the metrics in a record (``top_k`` becomes ``Top@k``).
PUBLISHED = {"avg_loc": "AverageLoc", "avg_rel_loc": "AverageRelLoc", "fdaro_v1": "FDARO@v1",
             "fdaro_v2": "FDARO@v2", "up_quartile": "UpQuartile"}


def published_name(metric: str) -> str:
    return PUBLISHED.get(metric, metric.replace("top_", "Top@"))


def rank_metrics(pos: DataFrame, by: Sequence[str] = ("ranker",), ks: Sequence[int] = DEFAULT_KS,
                 quartile: float = 0.75, digits: int = 6) -> DataFrame:
    """MET1-6 from ``fake_positions`` output.

    avg_loc, avg_rel_loc (loc / n, n incl. the fake), top_k (loc <= k),
    fdaro_v1 (fake above every relevant document; lists without one count),
    fdaro_v2 (same, only lists having a relevant document), up_quartile
    (loc / n <= quartile)."""
    rel = F.col("loc") / F.col("n")
    one = lambda cond: F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n_queries"),
            F.round(F.avg("loc"), digits).alias("avg_loc"),
            F.round(F.avg(rel), digits).alias("avg_rel_loc")]
    aggs += [F.round(F.avg(one(F.col("loc") <= k)), digits).alias(f"top_{k}") for k in ks]
    aggs += [F.round(F.avg(one(F.col("n_rel_above") == 0)), digits).alias("fdaro_v1"),
             F.round(F.avg(F.when(F.col("n_rel") > 0, one(F.col("n_rel_above") == 0))), digits)
             .alias("fdaro_v2"),
             F.round(F.avg(one(rel <= quartile)), digits).alias("up_quartile")]
    return pos.groupBy(*by).agg(*aggs)


def position_summary(pos: DataFrame, by: Sequence[str] = ("ranker",), digits: int = 6) -> DataFrame:
    """MET7: median position, median share of better texts, weighted means.

    ``pct_better = (loc-1)/(n-1)`` (0 for a one-document list).  Weighted
    means: by list size n (bigger lists weigh more) and by 1/n."""
    by = list(by)
    g = by or ["_g"]
    p = pos.select(*by, "loc", "n", F.when(F.col("n") <= 1, F.lit(0.0))
                   .otherwise((F.col("loc") - 1) / (F.col("n") - 1)).alias("pct_better"))
    if not by:
        p = p.withColumn("_g", F.lit(0))
    med_loc = exact_percentile(p, "loc", 0.5, g, "median_loc")
    med_pct = exact_percentile(p, "pct_better", 0.5, g, "median_pct_better")
    w = p.groupBy(*g).agg(
        (F.sum(F.col("loc") * F.col("n")) / F.sum("n")).alias("wavg_loc_by_n"),
        (F.sum(F.col("loc") / F.col("n")) / F.sum(1.0 / F.col("n"))).alias("wavg_loc_by_inv_n"))
    out = med_loc.join(med_pct, g).join(w, g)
    return out.select(*by, *[F.round(F.col(c), digits).alias(c) for c in
                             ("median_loc", "median_pct_better", "wavg_loc_by_n", "wavg_loc_by_inv_n")])


def metrics_record(metrics: DataFrame, ranker: str = "ranker",
                   names: Sequence[str] | None = None) -> DataFrame:
    """MET12: long form ``(name = <Ranker>_<Metric>, value)`` of ``rank_metrics``,
    with the published metric names (``Bm25_AverageLoc``)."""
    names = list(names or [c for c in metrics.columns if c not in (ranker, "run", "n_queries")])
    keep = [c for c in metrics.columns if c == "run"]
    stacked = F.explode(F.array(*[F.struct(F.lit(published_name(n)).alias("metric"), F.col(n).cast("double").alias("value"))
                                   for n in names]))
    s = metrics.select(*keep, F.col(ranker), stacked.alias("_m"))
    return s.select(*keep, F.concat(F.col(ranker), F.lit("_"), F.col("_m.metric")).alias("name"),
                    F.col("_m.value").alias("value"))


def compare_runs(record: DataFrame, runs: Sequence[str]) -> DataFrame:
    """MET11: metric names as rows, the given runs as columns."""
    return record.groupBy("name").pivot("run", list(runs)).agg(F.first("value"))


def best_run(record: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """MET13: run with the best value of one metric (ties: smallest run name)."""
    r = record.where(F.col("name") == metric)
    key = F.struct((-F.col("value")) if higher else F.col("value"), F.col("run"))
    return r.groupBy("name").agg(F.min_by("run", key).alias("run"),
                                 (F.max("value") if higher else F.min("value")).alias("value"))


def length_histogram(df: DataFrame, width: int, text: str = "text",
                     by: Sequence[str] = ()) -> DataFrame:
    """MET10: counts of texts per word-count bucket ``[k*width, (k+1)*width)``."""
    n = F.size(word_tokens(text))
    return (df.select(*by, (F.floor(n / width) * width).cast("long").alias("bucket"))
            .groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n_texts")))


def _ngrams(tokens, n: int):
    idx = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n,
                  F.transform(idx, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def bleu(pairs: DataFrame, max_order: int = 4, hyp: str = "hyp", ref: str = "ref", digits: int = 6) -> DataFrame:
    """MET8: corpus BLEU (one reference per row, no smoothing).

    A row holds both texts, so n-grams are counted and clipped inside it: the
    n-grams of both sides are sorted together, and a run of the hypothesis is
    followed by the run of the same n-gram of the reference, if it has one.
    One scan; only one row per order and task is shuffled.  No rows or no
    words: lengths and score 0."""
    toks = pairs.select(word_tokens(hyp).alias("h"), word_tokens(ref).alias("r"))

    def grams(col: str, side: int, n: int):
        return F.transform(_ngrams(F.col(col), n),
                           lambda g: F.struct(F.lit(n).alias("order"), g.alias("g"), F.lit(side).alias("side")))

    every = F.concat(*[grams(c, side, n) for n in range(1, max_order + 1) for side, c in enumerate("hr")])
    terms = with_term_counts(toks.select(every.alias("_g")), "_g")

    def clipped(t, j):
        after = F.try_element_at("terms", j + 2)
        same = ((t["tok"]["side"] == 0) & (after["tok"]["side"] == 1) & (after["tok"]["order"] == t["tok"]["order"])
                & (after["tok"]["g"] == t["tok"]["g"]))
        return F.struct(t["tok"]["order"].alias("order"), t["tok"]["side"].alias("side"), t["tf"].alias("tf"),
                        F.when(same, F.least(t["tf"], after["tf"])).otherwise(0).alias("hit"))

    m = (terms.select(F.inline_outer(F.transform("terms", clipped))).groupBy("order")
         .agg(F.sum("hit").alias("match"), F.sum(F.when(F.col("side") == 0, F.col("tf"))).alias("total"),
              F.sum(F.when(F.col("side") == 1, F.col("tf"))).alias("ref_total")))

    def words(col: str):
        return F.coalesce(F.max(F.when(F.col("order") == 1, F.col(col))), F.lit(0)).cast("long")

    res = m.agg(F.count_if(F.col("match") > 0).alias("nz"),
                F.sum(F.when(F.col("match") > 0, F.log(F.col("match") / F.col("total")))).alias("logp"),
                words("total").alias("hyp_len"), words("ref_total").alias("ref_len"))
    bp = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)) \
        .otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    score = F.when((F.col("nz") < max_order) | (F.col("hyp_len") == 0), F.lit(0.0)) \
        .otherwise(bp * F.exp(F.col("logp") / max_order))
    return res.select(F.round(score, digits).alias("bleu"), "hyp_len", "ref_len")

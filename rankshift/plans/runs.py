"""Many generated documents against one candidate corpus (GEN7 variants,
checkpoints): score every run without re-tokenizing or replicating the
candidate lists.

Each run r adds exactly one document f_r to list q, so its BM25 statistics
follow from the base list's:  N_r = N + 1,  avgdl_r = (sum dl + dl_f) / N_r,
df_r(t) = df(t) + [t in f_r], and the vocabulary mean idf is the base sum
(taken with N + 1) corrected only for f_r's tokens.  Only base rows that hit
a query token are repeated per run.  Documents without a hit score 0, so
positions count them in bulk: they outrank the fake exactly when its score
is <= 0 (they come first in list order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.operators import rank
from rankshift.operators.metrics import rank_metrics
from rankshift.params import BM25Params
from rankshift.session import materialize

RANKERS = ("Bm25", "TfCosine")


def _idf(n, df):
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def run_positions(cands: DataFrame, queries: DataFrame, gen: DataFrame, rankers: Sequence[str] = RANKERS,
                  bm25: BM25Params = BM25Params(), digits: int = 6) -> DataFrame:
    """Positions per (ranker, run, qid), equal to scoring every list with its
    fake appended.  ``cands``: qid, idx, text, label; ``gen``: qid, run,
    text; ``queries``: qid, query."""
    base = materialize(rank.list_terms(cands, ["qid"]), "base_terms")
    docs = rank.doc_table(base, ["qid"])
    bstats = materialize(docs.groupBy("qid").agg(
        F.count(F.lit(1)).alias("N"), F.sum("dl").alias("sdl"), F.count_if(F.col("label") == 1).alias("n_rel"),
        F.max("idx").alias("_last")), "base_stats")
    fake_docs = (gen.join(bstats.select("qid", "_last"), "qid", "left")
                 .select("run", "qid", (F.coalesce("_last", F.lit(-1)) + 1).alias("idx"), "text",
                         F.lit(rank.FAKE).alias("label")))
    fterms = materialize(rank.list_terms(fake_docs, ["run", "qid"]), "fake_terms")
    fdoc = rank.doc_table(fterms, ["run", "qid"]).select("run", "qid", F.col("idx").alias("fidx"),
                                                          F.col("dl").alias("fdl"))
    qt = rank.query_terms(queries, ["qid"])
    btf = base.where(F.col("tok").isNotNull())
    ftf = fterms.where(F.col("tok").isNotNull()).select("run", "qid", "tok", F.col("tf").alias("ftf"))
    hits = btf.join(qt, ["qid", "tok"])  # base rows on query tokens, once for all runs
    fakes, scored = [], []

    if "Bm25" in rankers:
        k1, b, eps = bm25.k1, bm25.b, bm25.epsilon
        dfb = (btf.groupBy("qid", "tok").agg(F.count(F.lit(1)).alias("df"))
               .join(bstats.select("qid", "N"), "qid")
               .withColumn("idf1", _idf(F.col("N") + 1, F.col("df"))))
        vsum = dfb.groupBy("qid").agg(F.sum("idf1").alias("S"), F.count(F.lit(1)).alias("Vb"))
        fd = (ftf.join(dfb.select("qid", "tok", "df", "idf1"), ["qid", "tok"], "left")
              .join(bstats.select("qid", "N"), "qid", "left")
              .withColumn("dfr", F.coalesce("df", F.lit(0)) + 1))
        fd = fd.withColumn("idfr", _idf(F.coalesce("N", F.lit(0)) + 1, F.col("dfr")))
        adj = fd.groupBy("run", "qid").agg(
            F.sum(F.col("idfr") - F.coalesce("idf1", F.lit(0.0))).alias("D"),
            F.count_if(F.col("df").isNull()).alias("Vnew"))
        runs = (fdoc.join(bstats, "qid", "left").join(vsum, "qid", "left").join(adj, ["run", "qid"], "left")
                .select("run", "qid", (F.coalesce("N", F.lit(0)) + 1).alias("Nr"),
                        ((F.coalesce("sdl", F.lit(0)) + F.col("fdl")) / (F.coalesce("N", F.lit(0)) + 1)).alias("avgdl"),
                        F.when((F.coalesce("Vb", F.lit(0)) + F.coalesce("Vnew", F.lit(0))) == 0, F.lit(0.0))
                        .otherwise((F.coalesce("S", F.lit(0.0)) + F.coalesce("D", F.lit(0.0)))
                                   / (F.coalesce("Vb", F.lit(0)) + F.coalesce("Vnew", F.lit(0)))).alias("mean_idf")))
        runs = materialize(runs, "run_stats")
        qw = (qt.join(runs.select("run", "qid", "Nr", "mean_idf"), "qid")
              .join(dfb.select("qid", "tok", "df"), ["qid", "tok"], "left")
              .join(ftf.select("run", "qid", "tok", F.lit(1).alias("_in")), ["run", "qid", "tok"], "left"))
        qw = qw.withColumn("dfr", F.coalesce("df", F.lit(0)) + F.coalesce("_in", F.lit(0))).where(F.col("dfr") > 0)
        idfr = _idf(F.col("Nr"), F.col("dfr"))
        qw = qw.select("run", "qid", "tok", "qn",
                       F.when(idfr < 0, F.col("mean_idf") * eps).otherwise(idfr).alias("w"))

        def part(tf):
            norm = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")
            return F.col("qn") * F.col("w") * tf * (k1 + 1.0) / (tf + F.lit(k1) * norm)

        avg = runs.select("run", "qid", "avgdl")
        bs = (hits.join(qw.drop("qn"), ["qid", "tok"]).join(avg, ["run", "qid"])
              .groupBy("run", "qid", "idx", "label").agg(F.sum(part(F.col("tf"))).alias("_s")))
        scored.append(bs.select(F.lit("Bm25").alias("ranker"), "run", "qid", "idx", "label",
                                F.round("_s", digits).alias("score")))
        fs = (ftf.join(qw, ["run", "qid", "tok"]).join(fdoc.withColumnRenamed("fdl", "dl"), ["run", "qid"])
              .join(avg, ["run", "qid"]).groupBy("run", "qid").agg(F.sum(part(F.col("ftf"))).alias("_fs")))
        fakes.append(fdoc.join(fs, ["run", "qid"], "left").select(
            F.lit("Bm25").alias("ranker"), "run", "qid", "fidx",
            F.round(F.coalesce("_fs", F.lit(0.0)), digits).alias("fs")))

    if "TfCosine" in rankers:
        qnorm = qt.groupBy("qid").agg(F.sqrt(F.sum(F.col("qn") * F.col("qn"))).alias("qnorm"))
        dnorm = btf.groupBy("qid", "idx").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
        bcos = (hits.groupBy("qid", "idx", "label").agg(F.sum(F.col("tf") * F.col("qn")).cast("double").alias("_d"))
                .join(dnorm, ["qid", "idx"]).join(qnorm, "qid")
                .select("qid", "idx", "label", F.round(F.col("_d") / (F.col("dn") * F.col("qnorm")), digits)
                        .alias("score")))
        scored.append(bcos.join(fdoc.select("run", "qid"), "qid").select(
            F.lit("TfCosine").alias("ranker"), "run", "qid", "idx", "label", "score"))
        fn = ftf.groupBy("run", "qid").agg(F.sqrt(F.sum(F.col("ftf") * F.col("ftf"))).alias("fn"))
        fdot = ftf.join(qt, ["qid", "tok"]).groupBy("run", "qid").agg(
            F.sum(F.col("ftf") * F.col("qn")).cast("double").alias("_d"))
        fc = (fdoc.join(fdot, ["run", "qid"], "left").join(fn, ["run", "qid"], "left").join(qnorm, "qid", "left")
              .select(F.lit("TfCosine").alias("ranker"), "run", "qid", "fidx",
                      F.round(F.when(F.col("_d").isNull(), F.lit(0.0))
                              .otherwise(F.col("_d") / (F.col("fn") * F.col("qnorm"))), digits).alias("fs")))
        fakes.append(fc)

    hits_all, fake_all = scored[0], fakes[0]
    for s in scored[1:]:
        hits_all = hits_all.unionByName(s)
    for f in fakes[1:]:
        fake_all = fake_all.unionByName(f)
    return positions_from_hits(hits_all, fake_all, bstats)


def positions_from_hits(hits: DataFrame, fakes: DataFrame, bstats: DataFrame) -> DataFrame:
    """Positions from scored hit rows plus per-list totals (see module notes)."""
    k = ["ranker", "run", "qid"]
    j = hits.join(fakes, k)
    above = (F.col("score") > F.col("fs")) | ((F.col("score") == F.col("fs")) & (F.col("idx") < F.col("fidx")))
    rel = F.col("label") == 1
    agg = j.groupBy(*k).agg(F.count(F.lit(1)).alias("n_hit"), F.count_if(rel).alias("n_rel_hit"),
                            F.count_if(above).alias("hit_above"), F.count_if(rel & above).alias("rel_hit_above"))
    p = fakes.join(agg, k, "left").join(bstats.select("qid", "N", "n_rel"), "qid", "left")
    zero_wins = F.col("fs") <= 0
    n_base = F.coalesce("N", F.lit(0))
    nrel = F.coalesce("n_rel", F.lit(0))
    return p.select(
        *k, (n_base + 1).alias("n"),
        (F.coalesce("hit_above", F.lit(0)) + 1 +
         F.when(zero_wins, n_base - F.coalesce("n_hit", F.lit(0))).otherwise(F.lit(0))).alias("loc"),
        nrel.alias("n_rel"),
        (F.coalesce("rel_hit_above", F.lit(0)) +
         F.when(zero_wins, nrel - F.coalesce("n_rel_hit", F.lit(0))).otherwise(F.lit(0))).alias("n_rel_above"))


def run_metrics(cands: DataFrame, queries: DataFrame, gen: DataFrame, rankers: Sequence[str] = RANKERS,
                ks: Sequence[int] = (1, 3, 5), quartile: float = 0.75) -> DataFrame:
    pos = materialize(run_positions(cands, queries, gen, rankers), "run_positions")
    return rank_metrics(pos, ["ranker", "run"], ks, quartile)

"""Ranking evaluation end to end (reference: generate -> mix -> rank -> metrics).

``scored_lists`` puts every ranker's scores in one long table
``(ranker, keys, idx, label, score)`` so positions and metrics for all
rankers come out of the same two aggregations.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.operators import generate as gen_ops
from rankshift.operators import prep, rank, sampling
from rankshift.operators.metrics import metrics_record, rank_metrics
from rankshift.params import BM25Params, EvalParams
from rankshift.session import materialize
from rankshift.sources import sinks

RANKERS = ("Bm25", "TfCosine")


def scored_lists(lists: DataFrame, queries: DataFrame, keys: Sequence[str] = ("qid",),
                 rankers: Sequence[str] = RANKERS, bm25: BM25Params = BM25Params(),
                 materialize_terms: bool = True) -> DataFrame:
    """``lists``: keys, idx, text, label (fake included, label -1).

    The term table is computed once and (by default) written to the shared
    checkpoint folder, so every ranker and the label lookup read it instead
    of re-tokenizing the corpus."""
    keys = list(keys)
    terms = rank.list_terms(lists, keys)
    if materialize_terms:
        terms = materialize(terms, "list_terms")
    q = queries.select(*keys, "query") if all(k in queries.columns for k in keys) else queries
    qt = rank.query_terms(q, keys)
    parts = []
    for r in rankers:
        if r == "Bm25":
            s = rank.bm25_from_terms(terms, qt, keys, bm25.k1, bm25.b, bm25.epsilon)
        elif r == "TfCosine":
            s = rank.tf_cosine_from_terms(terms, qt, keys)
        else:
            raise NotImplementedError(f"unknown ranker {r}")
        parts.append(s.select(F.lit(r).alias("ranker"), *keys, "idx", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    labels = rank.doc_table(terms, keys).select(*keys, "idx", "label")
    return out.join(labels, keys + ["idx"])


def scored_repeats(cands: DataFrame, gen: DataFrame, queries: DataFrame, keys: Sequence[str],
                   rankers: Sequence[str] = RANKERS, bm25: BM25Params = BM25Params()) -> DataFrame:
    """``scored_lists`` of lists that stand once in ``cands`` and once more for each value of the keys it lacks
    (``run``), each with its own fakes.  Terms of the candidates are written once: what repeats is one row a document
    and the rows on query words, never a text or its terms.

    A word's document frequency is that of the candidates plus that of the fakes; the mean idf is summed over the
    candidates' frequencies (one row a list and frequency), corrected for the words of the fakes."""
    keys = list(keys)
    shared = [k for k in keys if k in cands.columns]
    base = materialize(rank.list_terms(cands, shared), "list_terms")
    own = rank.doc_table(base, shared)
    last = own.groupBy(*shared).agg(F.max("idx").alias("_last"))
    fakes = gen.join(last, shared, "left").select(
        *keys, (F.coalesce("_last", F.lit(-1)) + 1).alias("idx"), "text", F.lit(rank.FAKE).alias("label"))
    extra = materialize(rank.list_terms(fakes, keys), "fake_terms")
    lists = gen.select(*keys).distinct()
    docs = materialize(own.join(lists, shared).select(*keys, "idx", "label", "dl")
                       .unionByName(rank.doc_table(extra, keys).select(*keys, "idx", "label", "dl")), "list_docs")
    btf, etf = (t.where(F.col("tok").isNotNull()) for t in (base, extra))
    asked = rank.query_terms(queries.select(*keys, "query"), keys)

    def idf(df):
        return F.log(F.col("n_docs") - df + 0.5) - F.log(df + 0.5)

    if "Bm25" in rankers:
        k1, b = bm25.k1, bm25.b
        stats = materialize(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")), "list_stats")
        of_base = materialize(btf.groupBy(*shared, "tok").agg(F.count(F.lit(1)).alias("df")), "list_df")
        of_fakes = etf.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("more"))
        kinds = of_base.groupBy(*shared, "df").agg(F.count(F.lit(1)).alias("m"))
        total = (kinds.join(lists, shared).join(stats, keys).groupBy(*keys)
                 .agg(F.sum(F.col("m") * idf(F.col("df"))).alias("all"), F.sum("m").alias("words")))
        new = of_fakes.join(of_base, [*shared, "tok"], "left").join(stats, keys)
        old_idf = F.when(F.col("df").isNull(), F.lit(0.0)).otherwise(idf(F.col("df")))
        new = new.groupBy(*keys).agg(F.sum(idf(F.coalesce("df", F.lit(0)) + F.col("more")) - old_idf).alias("plus"),
                                     F.count_if(F.col("df").isNull()).alias("more_words"))
        mean = (stats.join(total, keys, "left").join(new, keys, "left")
                .select(*keys, "n_docs", "avgdl", F.try_divide(
                    F.coalesce("all", F.lit(0.0)) + F.coalesce("plus", F.lit(0.0)),
                    F.coalesce("words", F.lit(0)) + F.coalesce("more_words", F.lit(0))).alias("mean_idf")))
        weights = (asked.join(of_base, [*shared, "tok"], "left").join(of_fakes, [*keys, "tok"], "left")
                   .withColumn("df", F.coalesce("df", F.lit(0)) + F.coalesce("more", F.lit(0))).where(F.col("df") > 0)
                   .join(mean, keys).withColumn("idf", idf(F.col("df"))))
        weights = weights.select(*keys, "tok", "qn", "avgdl", F.when(
            F.col("idf") < 0, F.col("mean_idf") * bm25.epsilon).otherwise(F.col("idf")).alias("w"))
        part = (F.col("qn") * F.col("w") * F.col("tf") * (k1 + 1.0)
                / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))))
    else:
        weights, part = asked, F.lit(0.0)
    weights = materialize(weights, "asked_words")  # small: read back so that the planner knows its size
    cols = [*keys, "idx", "dl", "tf", *(c for c in weights.columns if c not in (*keys, "tok"))]
    hits = (btf.join(weights, [*shared, "tok"]).select(*cols)
            .unionByName(etf.join(weights, [*keys, "tok"]).select(*cols)))
    hits = materialize(hits.groupBy(*keys, "idx").agg(
        F.sum(part).alias("_s"), F.sum(F.col("tf") * F.col("qn")).cast("double").alias("_dot")), "list_hits")
    rows = docs.select(*keys, "idx").join(hits, [*keys, "idx"], "left")
    parts = []
    for r in rankers:
        if r == "Bm25":
            s = rows.select(*keys, "idx", F.round(F.coalesce("_s", F.lit(0.0)), 6).alias("score"))
        elif r == "TfCosine":
            square = F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn")
            dn = (btf.groupBy(*shared, "idx").agg(square).join(lists, shared).select(*keys, "idx", "dn")
                  .unionByName(etf.groupBy(*keys, "idx").agg(square)))
            qnorm = asked.groupBy(*keys).agg(F.sqrt(F.sum(F.col("qn") * F.col("qn"))).alias("qnorm"))
            j = rows.join(dn, [*keys, "idx"], "left").join(qnorm, keys, "left")
            s = j.select(*keys, "idx", F.round(F.when(F.col("_dot").isNull(), F.lit(0.0)).otherwise(
                F.col("_dot") / (F.col("dn") * F.col("qnorm"))), 6).alias("score"))
        else:
            raise NotImplementedError(f"unknown ranker {r}")
        parts.append(s.select(F.lit(r).alias("ranker"), *keys, "idx", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(docs.select(*keys, "idx", "label"), [*keys, "idx"])


def fake_positions_for(cands: DataFrame, queries: DataFrame, gen: DataFrame,
                       keys: Sequence[str] = ("qid",), rankers: Sequence[str] = RANKERS,
                       materialize_positions: bool = True, bm25: BM25Params = BM25Params()) -> DataFrame:
    """Positions of the fake per (ranker, keys); small (one row per list),
    written once so metric passes over it do not replay the scoring."""
    keys = list(keys)
    repeats = [k for k in keys if k not in cands.columns]
    if repeats:
        gen = materialize(gen, "generated_texts")
    q = queries
    if "run" in keys and "run" not in queries.columns:
        q = queries.join(gen.select("qid", "run").distinct(), "qid")
    if repeats:
        scored = scored_repeats(cands, gen, q, keys, rankers, bm25)
    else:
        scored = scored_lists(rank.with_fake(cands, gen, keys), q, keys, rankers, bm25)
    pos = rank.fake_positions(scored, ["ranker"] + keys)
    return materialize(pos, "fake_positions") if materialize_positions else pos


def evaluate_fakes(cands: DataFrame, queries: DataFrame, gen: DataFrame,
                   keys: Sequence[str] = ("qid",), rankers: Sequence[str] = RANKERS,
                   ks: Sequence[int] = (1, 3, 5), quartile: float = 0.75) -> DataFrame:
    """Metrics per ranker (and per run when ``gen`` has a ``run`` column)."""
    keys = list(keys)
    pos = fake_positions_for(cands, queries, gen, keys, rankers)
    by = ["ranker"] + [k for k in keys if k == "run"]
    return rank_metrics(pos, by, ks, quartile)


def generated(queries: DataFrame, cands: DataFrame, params: EvalParams, bigrams: DataFrame | None = None) -> DataFrame:
    """(qid, text): one text a query by the run's generator, stripped of its prompt if the run says so."""
    if params.generator == "ngram":
        if bigrams is None:
            raise ValueError("the ngram generator needs bigram counts")
        made = sampling.sample_texts(queries, bigrams, params.gen.to_dict()).withColumnRenamed("generated_text", "text")
    elif params.generator in ("echo", "extractive"):
        made = getattr(gen_ops, f"{params.generator}_texts")(queries, cands, params.max_words)
    else:
        raise NotImplementedError(f"unknown generator {params.generator!r}")
    if params.strip_prompt:
        made = gen_ops.strip_prompt(made.join(queries.select("qid", "query"), "qid"))
    return made.select("qid", "text")


def evaluate_run(queries: DataFrame, cands: DataFrame, params: EvalParams, folder: str, run: str | None = None,
                 bigrams: DataFrame | None = None) -> str:
    """One evaluation run from its parameters: the first ``total_samples`` queries, one text each, mixed into their
    lists, ranked, measured.  Writes ``metrics``, ``examples`` (all rows of some batches) and ``runs`` (the
    parameters used) below ``folder`` and returns the run id; the same run id again replaces metrics and examples.

    ``queries``: qid (the order), query.  ``cands``: qid, idx, text, label."""
    spark, run = queries.sparkSession, run or sinks.run_id(params.launch_description)
    asked = materialize(prep.head_n(queries, params.total_samples, "qid"), "eval_queries")
    made = materialize(generated(asked, cands, params, bigrams), "eval_texts")
    lists = cands.join(asked.select("qid"), "qid", "left_semi")
    pos = fake_positions_for(lists, asked, made, bm25=params.bm25)
    sinks.write_metrics(metrics_record(rank_metrics(pos, ["ranker"], params.ks, params.quartile)),
                        os.path.join(folder, "metrics"), run)
    if params.number_examples_batch > 0:
        rows = asked.join(made.withColumnRenamed("text", "generated_text"), "qid")
        sinks.write_examples(prep.sample_batches(rows, params.number_examples_batch, params.batch_size, params.seed, "qid"),
                             os.path.join(folder, "examples"), run)
    sinks.write_run_params(spark, os.path.join(folder, "runs"), run, params.to_dict())
    return run

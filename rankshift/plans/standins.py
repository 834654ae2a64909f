"""How the driver tables stand in for the reference's data shapes.

* query           = ``benchmark.text``, ``qid = item_id``
* candidate list  = ``documents`` with ``qid = doc_id % count(benchmark)``,
                    ``idx = doc_id``; relevance = ``labels.quality`` (0 if unlabelled)
* nested QA rows  = ``conversations``: first user turn = query, assistant
                    turns in order = passages, the first one selected
* query/body pair = a user turn and the next assistant turn of a conversation
* vectors         = ``embeddings``: ``qid = vec_id div 25``; the first of a
                    group is the query, the last the fake; relevant = same label

The count of ``benchmark`` is a lazy scalar subquery, not a driver value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankshift.sources.tables import table

VEC_GROUP = 25


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    nq = table(spark, sf, "benchmark").select(F.count(F.lit(1))).scalar()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return (docs.join(labels, "doc_id", "left")
            .select(F.pmod(F.col("doc_id"), nq).alias("qid"), F.col("doc_id").alias("idx"), "text",
                    F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("label")))


def qa_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows ``(ord, query, passages struct<is_selected, passage_text>)``.

    One row per conversation that has a user turn; a conversation is the
    unit the nested format stores whole."""
    c = table(spark, sf, "conversations")
    first_user = (c.where(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("query")))
    answers = (c.where(F.col("role") == "assistant").groupBy("conv_id")
               .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_a")))
    j = first_user.join(answers, "conv_id", "left")
    texts = F.coalesce(F.transform("_a", lambda s: s["text"]), F.array().cast("array<string>"))
    sel = F.transform(texts, lambda t, i: F.when(i == 0, F.lit(1)).otherwise(F.lit(0)))
    return j.select(F.col("conv_id").alias("ord"), "query",
                    F.struct(sel.alias("is_selected"), texts.alias("passage_text")).alias("passages"))


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(ord, query, body, label): a user turn and the next turn when that one
    is an assistant turn.  ``label`` = 3 (top grade) for every pair."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    nxt = c.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"),
                   F.col("role").alias("_nrole"), F.col("text").alias("body"))
    j = c.where(F.col("role") == "user").join(nxt, ["conv_id", "turn"])
    return j.where(F.col("_nrole") == "assistant").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("ord"), F.col("text").alias("query"), "body",
        F.lit(3).alias("label"))


def vector_lists(spark: SparkSession, sf: str):
    """-> (docs: qid, idx, label, embedding; queries: qid, qvec).

    One scan; the windows run over groups of at most ``VEC_GROUP`` rows."""
    e = table(spark, sf, "embeddings")
    g = e.select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / VEC_GROUP).alias("qid"),
                 F.pmod(F.col("vec_id"), F.lit(VEC_GROUP)).alias("pos"))
    w = Window.partitionBy("qid")
    g = g.select("*", F.max("pos").over(w).alias("_last"),
                 F.first(F.when(F.col("pos") == 0, F.col("label")), ignorenulls=True).over(w).alias("qlabel"))
    q = g.where(F.col("pos") == 0).select("qid", F.col("embedding").alias("qvec"))
    d = g.where(F.col("pos") > 0).select(
        "qid", F.col("vec_id").alias("idx"), "embedding",
        F.when(F.col("pos") == F.col("_last"), F.lit(-1))
        .when(F.col("label") == F.col("qlabel"), F.lit(1)).otherwise(F.lit(0)).alias("label"))
    return d, q


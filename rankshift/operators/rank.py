"""Per-list scoring and the position of the generated ("fake") document.

A *list* is identified by the ``keys`` columns (``qid``, optionally ``run``);
documents inside it by ``idx``.  Label convention: 1 relevant, 0 not,
``FAKE`` (-1) the generated document.

Scale notes: every shuffle is keyed by ``(list keys, tok)`` or
``(list keys, idx)``, never by the list key alone, so one list holding a
third of all documents still spreads over many tasks.  Positions are
conditional counts after an equi-join with the single fake row of each
list: no sort and no window over a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.functions.hashing import h32
from rankshift.functions.text import with_term_counts, word_tokens
from rankshift.functions.vectors import cosine, dot

FAKE = -1


def with_fake(cands: DataFrame, gen: DataFrame, keys: Sequence[str] = ("qid",),
              text: str = "text") -> DataFrame:
    """RNK1: append each list's generated text last (idx = max(idx)+1, label FAKE).

    ``cands``: keys + idx, text, label.  ``gen``: keys + text.  When ``gen``
    carries extra list keys (e.g. ``run``) that ``cands`` lacks, the
    candidates are repeated for each value by a join on the shared keys."""
    keys = list(keys)
    shared = [k for k in keys if k in cands.columns]
    last = cands.groupBy(*shared).agg(F.max("idx").alias("_last"))
    fake = (gen.join(last, shared, "left")
            .select(*keys, (F.coalesce(F.col("_last"), F.lit(-1)) + 1).alias("idx"),
                    F.col(text).alias("text"), F.lit(FAKE).alias("label")))
    extra = [k for k in keys if k not in cands.columns]
    base = cands.select(*shared, "idx", "text", F.col("label").cast("int").alias("label"))
    if extra:
        base = base.join(gen.select(*keys).distinct(), shared)
    return base.select(*keys, "idx", "text", "label").unionByName(fake)


def list_terms(docs: DataFrame, keys: Sequence[str] = ("qid",), text: str = "text") -> DataFrame:
    """(keys, tok, idx, label, dl, tf): one row per distinct token of a
    document; a document without tokens keeps one row with ``tok`` null, so
    list sizes and lengths can be read from this table alone.

    Term counts are computed inside each document row (no shuffle): the
    table is a narrow projection of the documents."""
    keys = list(keys)
    label = F.col("label") if "label" in docs.columns else F.lit(0)
    toks = docs.select(*keys, "idx", label.cast("int").alias("label"), word_tokens(text).alias("_toks"))
    toks = with_term_counts(toks.withColumn("dl", F.size("_toks")), "_toks", "_tc")
    e = toks.select(*keys, "idx", "label", "dl", F.posexplode_outer("_tc").alias("tpos", "_x"))
    # tpos 0 (or null for a document without tokens) marks one row per document
    return e.select(*keys, F.col("_x.tok").alias("tok"), "idx", "label", "dl",
                    F.coalesce(F.col("_x.tf"), F.lit(1)).cast("long").alias("tf"), "tpos")


def term_frequencies(docs: DataFrame, keys: Sequence[str] = ("qid",), text: str = "text") -> DataFrame:
    """(keys, tok, idx, dl, tf) for documents with at least one token."""
    return list_terms(docs, keys, text).where(F.col("tok").isNotNull()).drop("label", "tpos")


def doc_table(terms: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """(keys, idx, label, dl) from a ``list_terms`` table: a narrow filter on
    the one row per document marked by ``tpos`` (no shuffle)."""
    keys = list(keys)
    first = F.col("tpos").isNull() | (F.col("tpos") == 0)
    return terms.where(first).select(*keys, "idx", "label", "dl")


def query_terms(queries: DataFrame, keys: Sequence[str] = ("qid",), query: str = "query") -> DataFrame:
    """(keys, tok, qn): query tokens with their repeat count."""
    keys = list(keys)
    return (queries.select(*keys, F.explode(word_tokens(query)).alias("tok"))
            .groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("qn")))


def bm25_from_terms(terms: DataFrame, qterms: DataFrame, keys: Sequence[str] = ("qid",),
                    k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6) -> DataFrame:
    """RNK2 on a ``list_terms`` table and a ``query_terms`` table.

    The list is the corpus: N, avgdl and df come from the list only
    (generated document included).  idf = ln(N-df+.5) - ln(df+.5); a
    negative idf becomes ``epsilon * mean idf`` of the list vocabulary.
    Returns keys, idx, score (rounded to ``digits``)."""
    keys = list(keys)
    docs = doc_table(terms, keys)
    tf = terms.where(F.col("tok").isNotNull())
    stats = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = (tf.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("df"))
           .join(stats, keys)
           .select(*keys, "tok",
                   (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    mean_idf = idf.groupBy(*keys).agg(F.avg("idf").alias("mean_idf"))
    q = (qterms.join(idf, keys + ["tok"]).join(mean_idf, keys)
         .select(*keys, "tok", "qn",
                 F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf")).alias("w")))
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")
    part = F.col("qn") * F.col("w") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + F.lit(k1) * norm)
    hits = (tf.join(q, keys + ["tok"]).join(stats.select(*keys, "avgdl"), keys)
            .groupBy(*keys, "idx").agg(F.sum(part).alias("_s")))
    return (docs.join(hits, keys + ["idx"], "left")
            .select(*keys, "idx", F.round(F.coalesce(F.col("_s"), F.lit(0.0)), digits).alias("score")))


def tf_cosine_from_terms(terms: DataFrame, qterms: DataFrame, keys: Sequence[str] = ("qid",),
                         digits: int = 6, docs: DataFrame | None = None) -> DataFrame:
    """Lexical cosine between term-count vectors of query and document.  ``docs``: (keys, idx) of all documents if
    ``terms`` is not a ``list_terms`` table."""
    keys = list(keys)
    docs = doc_table(terms, keys) if docs is None else docs
    tf = terms.where(F.col("tok").isNotNull())
    dnorm = tf.groupBy(*keys, "idx").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    qnorm = qterms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("qn") * F.col("qn"))).alias("qnorm"))
    dots = (tf.join(qterms, keys + ["tok"]).groupBy(*keys, "idx")
            .agg(F.sum(F.col("tf") * F.col("qn")).cast("double").alias("_dot")))
    sc = (docs.select(*keys, "idx").join(dots, keys + ["idx"], "left")
          .join(dnorm, keys + ["idx"], "left").join(qnorm, keys, "left"))
    val = F.when(F.col("_dot").isNull(), F.lit(0.0)).otherwise(F.col("_dot") / (F.col("dn") * F.col("qnorm")))
    return sc.select(*keys, "idx", F.round(val, digits).alias("score"))


def hashed_cosine_from_terms(terms: DataFrame, qterms: DataFrame, keys: Sequence[str] = ("qid",), dim: int = 256,
                             digits: int = 6) -> DataFrame:
    """RNK3 with the built-in embedder: a text's vector holds its word counts in ``dim`` hashed places (md5 of the
    word).  Vectors stay sparse: the places that occur are rows, and the cosine is that of ``tf_cosine_from_terms``."""
    keys = list(keys)
    place = F.pmod(h32(F.col("tok")), F.lit(dim)).alias("tok")
    docs = doc_table(terms, keys)
    spots = terms.where(F.col("tok").isNotNull()).groupBy(*keys, "idx", place).agg(F.sum("tf").alias("tf"))
    asked = qterms.groupBy(*keys, place).agg(F.sum("qn").alias("qn"))
    return tf_cosine_from_terms(spots, asked, keys, digits, docs)


def _terms(docs, keys, text, materialize_terms):
    t = list_terms(docs, keys, text)
    if materialize_terms:
        from rankshift.session import materialize
        t = materialize(t, "list_terms")
    return t


def score_bm25(docs: DataFrame, queries: DataFrame, keys: Sequence[str] = ("qid",),
               k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
               digits: int = 6, text: str = "text", query: str = "query",
               materialize_terms: bool = True) -> DataFrame:
    """RNK2 from raw texts (see ``bm25_from_terms``).  The term table is read
    four times, so by default it is written once to the checkpoint folder."""
    return bm25_from_terms(_terms(docs, keys, text, materialize_terms), query_terms(queries, keys, query),
                           keys, k1, b, epsilon, digits)


def score_tf_cosine(docs: DataFrame, queries: DataFrame, keys: Sequence[str] = ("qid",),
                    digits: int = 6, text: str = "text", query: str = "query",
                    materialize_terms: bool = True) -> DataFrame:
    return tf_cosine_from_terms(_terms(docs, keys, text, materialize_terms), query_terms(queries, keys, query),
                                keys, digits)


def score_vectors(docs: DataFrame, queries: DataFrame, keys: Sequence[str] = ("qid",),
                  how: str = "cosine", digits: int = 6, vec: str = "embedding",
                  qvec: str = "qvec") -> DataFrame:
    """RNK3 (cosine) / RNK5 (dot) on stored vectors.  The query vector is
    attached by an equi-join on the list key (one row per list)."""
    keys = list(keys)
    fn = cosine if how == "cosine" else dot
    j = docs.join(queries.select(*keys, qvec), keys)
    return j.select(*keys, "idx", F.round(fn(vec, qvec), digits).alias("score"))


def embed_with(df: DataFrame, embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Attach vectors from a pluggable embedder (pandas UDF, Arrow batches).

    ``embedder(pd.Series[str]) -> pd.Series[list[float]]`` is built once per
    Python worker by the caller's closure."""
    import pandas as pd

    def _emb(s):
        return embedder(s)

    # real (not postponed) annotations: pandas_udf infers the UDF kind from them
    _emb.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(_emb, "array<float>")(F.col(text)))


def score_pairs(pairs: DataFrame, scorer, keys: Sequence[str] = ("qid",),
                query: str = "query", text: str = "text") -> DataFrame:
    """RNK4: pluggable pair scorer (cross-/bi-encoder slot) over (query, text)
    rows with ``mapInPandas``; ``scorer(queries, texts) -> scores``."""
    keys = list(keys)
    cols = keys + ["idx", query, text]
    schema = ", ".join([f"{k} {dict(pairs.dtypes)[k]}" for k in keys] + ["idx bigint", "score double"])

    def run(batches):
        for pdf in batches:
            out = pdf[keys + ["idx"]].copy()
            out["score"] = scorer(pdf[query].fillna(""), pdf[text].fillna("")).astype("float64").to_numpy()
            yield out

    return pairs.select(*cols).mapInPandas(run, schema)


def fake_positions(scored: DataFrame, keys: Sequence[str] = ("ranker", "qid")) -> DataFrame:
    """RNK6: 1-based position of the fake in its list, best score first; on
    equal scores the earlier document wins (the fake is last, so it loses).

    Input: keys + idx, label, score.  Output per list: n (list size incl.
    the fake), loc, n_rel, n_rel_above (relevant documents ranked above)."""
    keys = list(keys)
    fake = scored.where(F.col("label") == FAKE).select(
        *keys, F.col("score").alias("_fs"), F.col("idx").alias("_fidx"))
    j = scored.join(fake, keys)
    above = (F.col("score") > F.col("_fs")) | ((F.col("score") == F.col("_fs")) & (F.col("idx") < F.col("_fidx")))
    rel = F.col("label") == 1
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if((F.col("label") != FAKE) & above) + 1).alias("loc"),
        F.count_if(rel).alias("n_rel"),
        F.count_if(rel & above).alias("n_rel_above"),
    )

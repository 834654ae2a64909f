"""Interpolated modified Kneser-Ney language model by counting (GEN5, MET9).

Texts are ``<s>`` + words + ``</s>``; a *window* is a word with its at most
``order - 1`` predecessors.  Windows are counted inside each text, so the model
and the scores read one narrow table and no text is unnested twice.

- Adjusted counts: the highest order and grams that start a text count
  occurrences, any other gram the distinct words to its left.  Each order is
  aggregated from the gram table of the order above, never from the text.
- Discounts D1, D2, D3+ of each order come from counts of counts
  (D_k = k - (k + 1) Y t_{k+1} / t_k with Y = t_1 / (t_1 + 2 t_2)); where one is
  undefined or outside (0, k], the three are 0.5, 1 and 1.5.
- Every gram carries its interpolated probability and, as a context, the
  weight it hands down.  The order-1 model is interpolated with 1/V, V = words
  + the unknown word.

All tables are keyed by the whole gram, so no key is hotter than its gram: the
empty context never is a join key (its sums are one row a group, joined as a
small table).  Context sums are partial aggregates.  A window is scored once
however many texts hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankshift.functions.text import with_term_counts, word_tokens
from rankshift.operators import packed
from rankshift.operators.ngram import BOS, EOS, Model, Source, scored_windows, numbered
from rankshift.session import materialize


def doc_windows(df: DataFrame, key: str = "doc_id", by: Sequence[str] = ("lang",), text: str = "text",
                order: int = 3) -> DataFrame:
    """(key, by, gram, n): the windows of each text with their counts.  Training and scoring count the texts
    themselves, as packed chunks (``source`` of the table)."""
    if not 2 <= order <= 5:
        raise ValueError("order must be 2..5")
    keep = [key, *by]
    t = F.col("_t")
    padded = df.select(*keep, F.concat(F.array(F.lit(BOS)), word_tokens(text), F.array(F.lit(EOS))).alias("_t"))
    windows = F.transform(F.sequence(F.lit(2), F.size(t)), lambda i: F.array_join(
        F.slice(t, F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))), " "))
    rows = with_term_counts(padded.select(*keep, windows.alias("_w")), "_w", "_c")
    rows = rows.select(*keep, F.explode_outer("_c").alias("_x"))
    rows = rows.select(*keep, F.col("_x.tok").alias("gram"), F.col("_x.tf").alias("n"))
    rows.source, rows.order = Source(df, list(by), text), order
    return rows


def _length(gram: str = "gram") -> Column:
    return F.length(gram) - F.length(F.replace(F.col(gram), F.lit(" "), F.lit(""))) + 1


def adjusted_counts(windows: DataFrame, order: int, by: Sequence[str] = ("lang",)) -> dict[int, DataFrame]:
    """{k: (by, gram, a)} for k = 1..order from a ``doc_windows`` table."""
    by = list(by)
    seen = materialize(windows.groupBy(*by, "gram").agg(F.sum("n").alias("a")).withColumn("k", _length()), "kn_windows")
    out = {order: seen.where(F.col("k") == order).drop("k")}
    for k in range(order - 1, 0, -1):
        shorter = F.expr("substring(gram, locate(' ', gram) + 1)")
        lower = out[k + 1].groupBy(*by, shorter.alias("gram")).agg(F.count(F.lit(1)).alias("a"))
        # grams that start a text have no word to the left
        out[k] = materialize(lower.unionByName(seen.where(F.col("k") == k).drop("k")), f"kn_adjusted_{k}")
    return out


def discounts(grams: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """(by, d1, d2, d3) of one order from its counts of counts."""
    return _discounts(grams.groupBy(*by).agg(*(F.count_if(F.col("a") == i).alias(f"t{i}") for i in range(1, 5))), by)


def _discounts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, d1, d2, d3) from counts of counts (by, t1, ..., t4)."""
    t = counts.select(*by, *(F.col(f"t{i}").cast("double").alias(f"t{i}") for i in range(1, 5)))
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    ok = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0)
    d = [F.when(ok, i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")) for i in (1, 2, 3)]
    d = t.select(*by, *(c.alias(f"d{i}") for i, c in zip((1, 2, 3), d)))
    sane = F.lit(True)
    for i in (1, 2, 3):
        sane = sane & F.coalesce((F.col(f"d{i}") > 0) & (F.col(f"d{i}") <= i), F.lit(False))
    return d.select(*by, *(F.when(sane, F.col(f"d{i}")).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)))


def _discount(a: Column) -> Column:
    return F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))


def train_kn(windows: DataFrame, order: int = 3, by: Sequence[str] = ("lang",)) -> dict:
    """GEN5: {'grams': (by, gram, p, bow), 'unknown': (by, p_unk), 'order'}.

    ``p``: probability of the gram's last word after the others; ``bow``: weight a context hands to the next
    shorter one (null for grams that no text goes on from).  The tables are made when one of them is asked for."""
    source = getattr(windows, "source", None)
    if source is None or windows.order != order or source.by != list(by):
        return {**_kn_tables(windows, order, list(by)), "order": order}
    return Model({"order": order}, source, lambda: _kn_tables(windows, order, list(by)))


def _kn_tables(windows: DataFrame, order: int, by: list[str]) -> dict:
    """The tables of ``train_kn``."""
    counts = adjusted_counts(windows, order, by)
    a = F.col("a")
    probs, weights, unknown = {}, {}, None
    for k in range(1, order + 1):
        # small tables of one row a group, read back so that the planner knows their size
        d = materialize(discounts(counts[k], by), f"kn_discounts_{k}")
        rows = counts[k].join(d, by)
        ctx = [*by, F.substring_index("gram", " ", k - 1).alias("ctx")] if k > 1 else by
        tail = F.sum(F.col("d1") * (a == 1).cast("int") + F.col("d2") * (a == 2).cast("int")
                     + F.col("d3") * (a > 2).cast("int"))
        sums = rows.groupBy(*ctx).agg(F.sum("a").alias("all"), (tail / F.sum("a")).alias("bow"),
                                      F.count(F.lit(1)).alias("words"))
        if k == 1:
            sums = materialize(sums, "kn_unigrams")
            unknown = sums.select(*by, (F.col("bow") / (F.col("words") + 1)).alias("p_unk"))
            p = rows.join(sums, by).select(*by, "gram", ((a - _discount(a)) / F.col("all")
                                                         + F.col("bow") / (F.col("words") + 1)).alias("p"))
        else:
            weights[k - 1] = materialize(sums.select(*by, F.col("ctx").alias("gram"), "bow"), f"kn_weights_{k}")
            own = rows.select(*by, "gram", ((a - _discount(a))).alias("num"),
                              F.substring_index("gram", " ", k - 1).alias("ctx"),
                              F.expr("substring(gram, locate(' ', gram) + 1)").alias("tail"))
            sums = sums.select(*by, "ctx", "all", "bow")
            lower = probs[k - 1].select(*by, F.col("gram").alias("tail"), F.col("p").alias("below"))
            p = (own.join(sums, [*by, "ctx"]).join(lower, [*by, "tail"])
                 .select(*by, "gram", (F.col("num") / F.col("all") + F.col("bow") * F.col("below")).alias("p")))
        probs[k] = materialize(p, f"kn_probs_{k}")
    grams = probs[order].withColumn("bow", F.lit(None).cast("double"))
    for k in range(1, order):  # outer: the start mark is a context only
        grams = grams.unionByName(materialize(probs[k].join(weights[k], [*by, "gram"], "full"), f"kn_model_{k}"))
    return {"grams": grams, "unknown": unknown}


def window_probs(windows: DataFrame, lm: dict, by: Sequence[str] = ("lang",)) -> DataFrame:
    """(by, gram, lp): log-probability of the last word of each distinct window.

    The longest known gram gives the probability; the contexts above it hand down their weights."""
    by, order = list(by), lm["order"]
    looked = []
    for k in range(1, order + 1):
        suffix = F.substring_index("gram", " ", -k)
        looked.append(F.struct(F.lit(k).alias("k"), F.lit(True).alias("word"), suffix.alias("part")))
        if k > 1:
            looked.append(F.struct(F.lit(k).alias("k"), F.lit(False).alias("word"),
                                   F.substring_index(suffix, " ", k - 1).alias("part")))
    w = windows.select(*by, "gram").distinct().withColumn("size", _length())
    rows = w.select(*by, "gram", "size", F.explode(F.array(*looked)).alias("x")).where(F.col("x.k") <= F.col("size"))
    rows = rows.select(*by, "gram", "x.k", "x.word", F.col("x.part").alias("part"))
    found = rows.join(lm["grams"].withColumnRenamed("gram", "part"), [*by, "part"])
    got = found.groupBy(*by, "gram").agg(F.collect_list(F.struct("k", "word", "p", "bow")).alias("g"))
    # every window of a known group finds a unigram, except unknown words with unknown contexts
    got = w.select(*by, "gram").join(got, [*by, "gram"], "left").join(lm["unknown"], by, "left")
    best = F.aggregate(F.coalesce("g", F.array().cast("array<struct<k:int,word:boolean,p:double,bow:double>>")),
                       F.struct(F.lit(0).alias("k"), F.col("p_unk").alias("p")),
                       lambda acc, x: F.when(x["word"] & (x["k"] > acc["k"]) & x["p"].isNotNull(),
                                             F.struct(x["k"].alias("k"), x["p"].alias("p"))).otherwise(acc))
    got = got.withColumn("best", best)
    handed = F.aggregate(F.coalesce("g", F.array().cast("array<struct<k:int,word:boolean,p:double,bow:double>>")),
                         F.lit(0.0), lambda acc, x: acc + F.when(~x["word"] & (x["k"] > F.col("best.k")),
                                                                 F.coalesce(F.log(x["bow"]), F.lit(0.0))).otherwise(0.0))
    return got.select(*by, "gram", (F.log(F.col("best.p")) + handed).alias("lp"))


def perplexity_kn(windows: DataFrame, lm: dict, key: str = "doc_id", by: Sequence[str] = ("lang",),
                  digits: int = 6) -> DataFrame:
    """MET9: exp(-mean log p) of each text over its words and the end mark, from its ``doc_windows`` table.

    A model with its texts is counted from them, chunk by chunk (``packed``).  Otherwise a window that is a gram of
    the model has that gram's probability, so one join settles it; the others look up their parts.  Texts of a group
    the model has not seen (null groups included) get a null perplexity."""
    by = list(by)
    if isinstance(lm, Model) and lm.packed(by) and getattr(windows, "order", None) == lm["order"]:
        return packed.kneser_ney_perplexity(numbered(lm, windows.source, key), lm["order"], key, digits, _discounts)
    known = lm["grams"].where(F.col("p").isNotNull()).select(*by, "gram", F.log("p").alias("lp"))
    return scored_windows(windows, known, lambda unseen: window_probs(unseen, lm, by), key, by, digits)

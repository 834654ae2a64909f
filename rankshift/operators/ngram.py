"""n-gram language model by counting (GEN5), perplexity (MET9) and the
perplexity cut (CLN7).

Counts are separate tables keyed by ``(group, w1, w2)``; scoring is a
shuffle join of each text's bigrams to them, never a broadcast of the model.
Smoothing: add-k over the group's vocabulary (V = distinct next-tokens + 1
for the unknown word), so unseen contexts give 1/V.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankshift.functions.text import with_term_counts, word_tokens
from rankshift.operators import packed
from rankshift.operators.stats import exact_percentile
from rankshift.session import materialize

BOS, EOS = "<s>", "</s>"


def _padded(text: str):
    return F.concat(F.array(F.lit(BOS)), word_tokens(text), F.array(F.lit(EOS)))


def _pairs(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep..., _p): the consecutive pairs of <s> + tokens + </s> as one array
    per row, never empty.  Unnest it by an *outer* generator: the inner ones add
    a size filter that is pushed down and tokenizes once per element."""
    # tokens are materialised once
    padded = df.select(*keep, _padded(text).alias("_t"))
    n = F.size("_t") - 1
    pairs = F.arrays_zip(F.slice("_t", F.lit(1), n).alias("w1"), F.slice("_t", F.lit(2), n).alias("w2"))
    return padded.select(*keep, pairs.alias("_p"))


def bigrams(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(keep..., w1, w2) for consecutive pairs of <s> + tokens + </s>."""
    return _pairs(df, keep, text).select(*keep, F.inline_outer("_p"))


def doc_bigrams(df: DataFrame, key: str = "doc_id", by: Sequence[str] = ("lang",), text: str = "text",
                materialize_table: bool = True) -> DataFrame:
    """(key, by, w1, w2, n): bigram counts per row.  A row holds the whole
    text, so its bigrams are counted inside it, without a shuffle.

    ``materialize_table``: the texts are also written once as packed chunks
    (``source`` of the table) when they are first counted, so that training and
    scoring on the same corpus tokenize it once."""
    keep = [key, *by]
    e = with_term_counts(_pairs(df, keep, text), "_p", "_terms").select(*keep, F.explode_outer("_terms").alias("_x"))
    t = e.select(*keep, F.col("_x.tok.w1").alias("w1"), F.col("_x.tok.w2").alias("w2"), F.col("_x.tf").alias("n"))
    if materialize_table:
        t.source = Source(df, list(by), text)
    return t


def train_bigram_lm(df: DataFrame, by: Sequence[str] = ("lang",), text: str = "text",
                    counted: DataFrame | None = None, written: bool = True) -> dict:
    """GEN5: {'bigrams': (by, w1, w2, c), 'contexts': (by, w1, cw1), 'vocab': (by, V)}.
    ``counted``: a ``doc_bigrams`` table to train from instead of raw text;
    ``written``: ``perplexity`` counts the texts as packed chunks, without
    making a row of any bigram."""
    by, source = list(by), getattr(counted, "source", None)
    if counted is not None:
        bg = counted.groupBy(*by, "w1", "w2").agg(F.sum("n").alias("c"))
    else:
        bg = bigrams(df, by, text).groupBy(*by, "w1", "w2").agg(F.count(F.lit(1)).alias("c"))
        source = Source(df, by, text) if written else None
    ctx = bg.groupBy(*by, "w1").agg(F.sum("c").alias("cw1"))
    voc = bg.groupBy(*by).agg((F.count_distinct("w2") + 1).alias("V"))
    lm = {"bigrams": bg, "contexts": ctx, "vocab": voc}
    return lm if source is None else Model(lm, source)


class Source:
    """Texts that are written as packed chunks when they are first counted."""

    def __init__(self, df: DataFrame, by: list[str], text: str):
        self.df, self.by, self.text, self.coded = df, by, text, {}

    def rows(self, key: str | None = None) -> DataFrame:
        """Under ``key``, or any key if the texts are only counted."""
        if key is None and self.coded:
            return next(iter(self.coded.values()))
        if key not in self.coded:
            df = self.df if key else self.df.withColumn("_none", F.lit(None).cast("int"))
            self.coded[key] = packed.coded_texts(df, key or "_none", self.by, self.text)
        return self.coded[key]


class Model(dict):
    """A model with the texts ``source`` that its tables come from.  ``make`` gives tables that not every use
    of the model needs; they are made when one is asked for."""

    def __init__(self, tables: dict, source: Source, make: Callable[[], dict] | None = None):
        super().__init__(tables)
        self.source, self.make, self.tables = source, make, dict(tables)

    def __missing__(self, name: str):
        if self.make is None:
            raise KeyError(name)
        made, self.make = self.make(), None
        self.tables.update(made)
        self.update({k: v for k, v in made.items() if k not in self})
        return self[name]

    def packed(self, by: list[str]) -> bool:
        """Whether the tables still are those of the texts."""
        return by == self.source.by and all(k in self.tables and v is self.tables[k] for k, v in self.items()) and all(
            k in self for k in self.tables)


def numbered(lm: Model, asked: Source, key: str) -> packed.Texts:
    """The texts of a model and the texts ``asked`` with their words numbered."""
    same = asked is lm.source or asked.df is lm.source.df and (asked.by, asked.text) == (lm.source.by, lm.source.text)
    rows = (lm.source if same else asked).rows(key)
    return packed.identified(rows if same else lm.source.rows(), None if same else rows, asked.by)


def perplexity(df: DataFrame, lm: dict, key: str = "doc_id", by: Sequence[str] = ("lang",),
               text: str = "text", k: float = 1.0, digits: int = 6, counted: DataFrame | None = None) -> DataFrame:
    """MET9: exp(-mean log p(w2|w1)) per text under the add-k bigram model.
    ``counted``: the texts' ``doc_bigrams`` table (each distinct bigram of a
    text is joined once and weighted by its count).

    A model with its texts is counted from them, chunk by chunk (``packed``).
    Otherwise the model's bigrams get their log-probability first, so a text's
    bigrams move for one join; contexts are looked up for unseen bigrams only."""
    by = list(by)
    if isinstance(lm, Model) and lm.packed(by):
        asked = Source(df, by, text) if counted is None else getattr(counted, "source", None)
        if asked is not None:
            return packed.bigram_perplexity(numbered(lm, asked, key), k, key, digits)
    b = counted if counted is not None else bigrams(df, [key] + by, text).withColumn("n", F.lit(1))
    voc = materialize(lm["vocab"], "bigram_vocab")  # one row a group, read back so that the planner knows its size

    def lp(c):
        return F.log((c + k) / (F.coalesce(F.col("cw1"), F.lit(0)) + k * F.coalesce(F.col("V"), F.lit(1)))).alias("lp")

    known = lm["bigrams"].join(lm["contexts"], by + ["w1"]).join(voc, by).select(*by, "w1", "w2", lp(F.col("c")))

    def unseen(grams: DataFrame) -> DataFrame:
        return (grams.join(lm["contexts"], by + ["w1"], "left").join(voc, by, "left")
                .select(*by, "w1", "w2", lp(F.lit(0))))

    return scored_windows(b, known, unseen, key, by, digits, ("w1", "w2"))


def perplexity_keep(ppl: DataFrame, keep: float = 1.0 / 3.0, by: Sequence[str] = ("lang",),
                    key: str = "doc_id") -> DataFrame:
    """CLN7: keys whose perplexity is at or below the group's ``keep``
    percentile (CCNet head = lowest third by default).  The percentile is
    exact and computed without holding a group in one task."""
    by = list(by)
    cut = exact_percentile(ppl, "perplexity", keep, by, "_cut")
    return ppl.join(cut, by).where(F.col("perplexity") <= F.col("_cut")).select(key, *by, "perplexity")


# ------------------------------------------- order-N, interpolated discounting

def window_rows(df: DataFrame, keep: Sequence[str], order: int, text: str = "text") -> DataFrame:
    """(keep..., gram): for every predicted token (real tokens and </s>, after
    order-1 <s> pads) the ``order`` tokens that end with it, space-joined.  The
    grams of lower orders are its suffixes."""
    pads = F.array_repeat(F.lit(BOS), order - 1) if order > 1 else F.array().cast("array<string>")
    padded = df.select(*keep, F.concat(pads, word_tokens(text), F.array(F.lit(EOS))).alias("_t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - (order - 1)),
                        lambda i: F.array_join(F.slice(F.col("_t"), i, order), " "))
    return padded.select(*keep, F.explode_outer(grams).alias("gram"))


def _suffix(gram: str = "gram") -> Column:
    """A gram of two words or more without its first."""
    return F.expr(f"substring({gram}, locate(' ', {gram}) + 1)")


def _context(k: int, gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", k - 1) if k > 1 else F.lit("")


def train_ngram_lm(df: DataFrame, order: int = 3, by: Sequence[str] = ("lang",), text: str = "text",
                   discount: float = 0.75) -> dict:
    """GEN5, order <= 5: counts of every order in one table keyed
    (by, k, ctx, w), context totals and distinct followers per (by, k, ctx),
    and V (distinct words + 1) per group.

    The texts are written once as packed chunks, which ``perplexity_ngram``
    counts; the tables are made when one of them is asked for."""
    if not 1 <= order <= 5:
        raise ValueError("order must be 1..5")
    by = list(by)
    return Model({"order": order, "discount": discount}, Source(df, by, text), lambda: _ngram_tables(df, order, by, text))


def _ngram_tables(df: DataFrame, order: int, by: list[str], text: str) -> dict:
    """The tables of ``train_ngram_lm``: only the highest order is counted from the text; each other order adds up
    the order above by its suffixes.  'grams': {k: (by, gram, c)}, written."""
    grams = {}
    rows = window_rows(df, by, order, text).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("c"))
    for k in range(order, 0, -1):
        if k < order:
            rows = grams[k + 1].groupBy(*by, _suffix().alias("gram")).agg(F.sum("c").alias("c"))
        grams[k] = materialize(rows, f"ngrams_{k}")
    cnt = None
    for k in range(1, order + 1):
        part = grams[k].select(*by, F.lit(k).alias("k"), _context(k).alias("ctx"),
                               F.substring_index("gram", " ", -1).alias("w"), "c")
        cnt = part if cnt is None else cnt.unionByName(part)
    ctx = cnt.groupBy(*by, "k", "ctx").agg(F.sum("c").alias("ch"), F.count(F.lit(1)).alias("n1p"))
    voc = grams[1].groupBy(*by).agg((F.count(F.lit(1)) + 1).alias("V"))
    return {"counts": cnt, "contexts": ctx, "vocab": voc, "grams": grams}


def _followers(lm: dict, by: list[str], k: int) -> DataFrame:
    """(by, ctx, ch, n1p) of one order from its written grams."""
    f = (lm["grams"][k].groupBy(*by, _context(k).alias("ctx"))
         .agg(F.sum("c").alias("ch"), F.count(F.lit(1)).alias("n1p")))
    return f if k > 1 else materialize(f, "ngram_words")  # one row a group


def perplexity_ngram(df: DataFrame, lm: dict, key: str = "doc_id", by: Sequence[str] = ("lang",),
                     text: str = "text", digits: int = 6) -> DataFrame:
    """MET9 under the order-N model:
    p_k(w|h) = max(c(h,w)-D, 0)/c(h) + D*N1+(h)/c(h) * p_{k-1}(w|h'),
    p_0 = 1/V, an unseen context passes p_{k-1} through.

    A model with its texts is counted from them, chunk by chunk (``packed``).
    Otherwise every gram of the model gets its p_k once, order by order; a text's windows
    then meet them in one join.  Only windows the model has not seen, written
    per text, look up their suffixes.  The model is joined, never broadcast."""
    by = list(by)
    d, order = lm["discount"], lm["order"]
    # texts that share their key are one text whose orders fold position by position
    shared = df.groupBy(key, *by).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1).drop("_m")
    shared = materialize(shared.select(*(F.col(c).alias(f"_{c}") for c in (key, *by))), "shared_keys")
    alone, folded = df, None
    if not shared.isEmpty():
        same = F.lit(True)
        for c in (key, *by):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        alone = df.join(shared, same, "left_anti")
        folded = _folded_positions(df.join(shared, same, "left_semi"), lm, key, by, text, digits)
    if isinstance(lm, Model) and lm.packed(by):
        out = packed.ngram_perplexity(numbered(lm, Source(alone, by, text), key), order, d, key, digits)
    else:
        out = _joined_windows(alone, lm, key, by, text, digits)
    return out if folded is None else out.unionByName(folded)


def _joined_windows(df: DataFrame, lm: dict, key: str, by: list[str], text: str, digits: int) -> DataFrame:
    """The perplexity of texts that do not share keys, from the tables of a model."""
    d, order = lm["discount"], lm["order"]
    voc = materialize(lm["vocab"], "ngram_vocab")  # one row a group
    probs = {}
    for k in range(1, order + 1):
        t = lm["grams"][k].withColumn("ctx", _context(k)).join(_followers(lm, by, k), [*by, "ctx"])
        if k == 1:
            t = t.join(voc, by).withColumn("below", F.lit(1.0) / F.col("V"))
        else:
            below = probs[k - 1].select(*by, F.col("gram").alias("_s"), F.col("p").alias("below"))
            t = t.withColumn("_s", _suffix()).join(below, [*by, "_s"])
        p = (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("ch") + F.lit(d) * F.col("n1p") / F.col("ch") * F.col("below"))
        probs[k] = materialize(t.select(*by, "gram", p.alias("p")), f"ngram_probs_{k}")
    known = probs[order].select(*by, "gram", F.log("p").alias("lp"))
    return scored_windows(window_rows(df, [key] + by, order, text).withColumn("n", F.lit(1)), known,
                          lambda unseen: _unseen_windows(unseen, lm, probs, voc, by), key, by, digits)


def _folded_positions(df: DataFrame, lm: dict, key: str, by: list[str], text: str, digits: int) -> DataFrame:
    """The perplexity of texts under one key: the terms that all of them have at a position fold in (k, a, b) order."""
    d, order = lm["discount"], lm["order"]
    pads = F.array_repeat(F.lit(BOS), order - 1) if order > 1 else F.array().cast("array<string>")
    t_df = df.select(key, *by, F.concat(pads, word_tokens(text), F.array(F.lit(EOS))).alias("_t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - (order - 1)),
                        lambda i: F.array_join(F.slice(F.col("_t"), i, order), " "))
    rows = t_df.select(key, *by, F.posexplode(grams).alias("i", "gram"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k")
    rows = rows.select(key, *by, "i", "gram", ks).withColumn("gram", F.expr("substring_index(gram, ' ', -k)"))
    rows = rows.select(key, *by, "i", "k", F.when(F.col("k") > 1, F.expr("substring_index(gram, ' ', k - 1)"))
                       .otherwise(F.lit("")).alias("ctx"), F.substring_index("gram", " ", -1).alias("w"))
    j = (rows.join(lm["counts"], by + ["k", "ctx", "w"], "left")
         .join(lm["contexts"], by + ["k", "ctx"], "left"))
    a = F.when(F.col("ch").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.coalesce(F.col("c"), F.lit(0)) - d, F.lit(0.0)) / F.col("ch"))
    b = F.when(F.col("ch").isNull(), F.lit(1.0)).otherwise(F.lit(d) * F.col("n1p") / F.col("ch"))
    per_tok = (j.groupBy(key, *by, "i").agg(F.array_sort(F.collect_list(F.struct("k", a.alias("a"), b.alias("b"))))
                                            .alias("_s"))
               .join(lm["vocab"], by, "left"))
    p = F.aggregate("_s", F.lit(1.0) / F.coalesce(F.col("V"), F.lit(1)), lambda acc, x: x["a"] + x["b"] * acc)
    return (per_tok.groupBy(key, *by).agg(F.exp(-F.avg(F.log(p))).alias("_ppl"))
            .select(key, *by, F.round("_ppl", digits).alias("perplexity")))


def _unseen_windows(grams: DataFrame, lm: dict, probs: dict, voc: DataFrame, by: list[str]) -> DataFrame:
    """(by, gram, lp) of windows of any words: an order with the suffix gives its p, one with the context alone its
    share of the order below, any other passes that through."""
    u = grams.join(voc, by, "left").withColumn("_p", F.lit(1.0) / F.coalesce(F.col("V"), F.lit(1)))
    for k in range(1, lm["order"] + 1):
        u = u.withColumn("_s", F.substring_index("gram", " ", -k)).withColumn("_c", _context(k, "_s"))
        heads = _followers(lm, by, k).withColumnRenamed("ctx", "_c")
        u = u.join(probs[k].withColumnRenamed("gram", "_s"), [*by, "_s"], "left")
        u = u.join(heads, [*by, "_c"], "left")
        passed = F.when(F.col("ch").isNull(), F.col("_p")).otherwise(F.lit(lm["discount"]) * F.col("n1p") / F.col("ch") * F.col("_p"))
        u = u.select(*by, "gram", F.coalesce("p", passed).alias("_p"))
    return u.select(*by, "gram", F.log("_p").alias("lp"))


def scored_windows(rows: DataFrame, known: DataFrame, unseen: Callable[[DataFrame], DataFrame], key: str, by: list[str],
                   digits: int, gram: Sequence[str] = ("gram",)) -> DataFrame:
    """(key, by, perplexity) from ``rows`` (key, by, gram, n) and the log-probabilities ``known`` (by, gram, lp).

    One join by the whole gram, added up per text; grams that ``known`` lacks stay rows of their text, and ``unseen``
    turns their distinct (by, gram) into (by, gram, lp)."""
    gram = list(gram)
    j = rows.join(known, [*by, *gram], "left")
    left = [F.when(F.col("lp").isNull(), F.col(g)).alias(g) for g in gram]
    sums = (j.groupBy(key, *by, *left).agg(F.sum(F.col("n") * F.col("lp")).alias("_l"), F.sum("n").alias("_n")))
    sums = materialize(sums, "perplexity_sums")
    open_ = sums.where(F.col(gram[0]).isNotNull())
    found = sums.where(F.col(gram[0]).isNull()).select(key, *by, "_l", "_n")
    if not open_.isEmpty():
        lp = unseen(open_.select(*by, *gram).distinct())
        same = F.lit(True)
        for c in (*by, *gram):  # null groups have scores of their own
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        lp = lp.select(*(F.col(c).alias(f"_{c}") for c in (*by, *gram)), "lp")
        found = found.unionByName(open_.drop("_l").join(lp, same, "left")
                                  .select(key, *by, (F.col("_n") * F.col("lp")).alias("_l"), "_n"))
    return (found.groupBy(key, *by).agg((F.sum("_l") / F.sum("_n")).alias("_l"))
            .select(key, *by, F.round(F.exp(-F.col("_l")), digits).alias("perplexity")))

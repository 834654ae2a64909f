"""Language models over hand-made rows: one join a window, unseen windows, shared and null keys."""

import math

import pytest
from pyspark.sql import functions as F

from rankshift.operators import kneser_ney as KN
from rankshift.operators import ngram as NG

SCHEMA = "doc_id long, lang string, text string"
ROWS = [(1, "en", "a b a b c"), (2, "en", "a b c"), (3, "de", "x y"), (4, None, "a b"), (5, "en", None)]
ASKED = [(1, "en", "a b c d a"), (2, "en", "q"), (3, "fr", "a b"), (4, None, "a")]


def _trigram(texts, asked, lang, d=0.75, order=3):
    """Plain p_k fold of one text."""
    pad = lambda t: ["<s>"] * (order - 1) + (t or "").split() + ["</s>"]
    c, ctx, words = {}, {}, set()
    for _, la, t in texts:
        if la == lang and la is not None:
            t = pad(t)
            words |= set(t[order - 1:])
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    h = tuple(t[i - k + 1:i])
                    c[h, t[i]] = c.get((h, t[i]), 0) + 1
                    ctx.setdefault(h, []).append(t[i])
    t, logs = pad(asked), []
    for i in range(order - 1, len(t)):
        p = 1.0 / (len(words) + 1)
        for k in range(1, order + 1):
            h = tuple(t[i - k + 1:i])
            if h in ctx:
                n = len(ctx[h])
                p = max(c.get((h, t[i]), 0) - d, 0) / n + d * len(set(ctx[h])) / n * p
        logs.append(math.log(p))
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_order_n_perplexity_of_seen_and_unseen_windows(spark, order):
    lm = NG.train_ngram_lm(spark.createDataFrame(ROWS, SCHEMA), order)
    for asked in (ROWS, ASKED):
        got = {r["doc_id"]: r["perplexity"] for r in NG.perplexity_ngram(spark.createDataFrame(asked, SCHEMA), lm).collect()}
        assert set(got) == {r[0] for r in asked}
        for i, lang, text in asked:
            assert got[i] == pytest.approx(_trigram(ROWS, text, lang, order=order), abs=1e-5), (i, order)


def test_texts_that_share_their_key_fold_together(spark):
    d = spark.createDataFrame([(1, "en", "a b"), (1, "en", "a b"), (2, "en", "a b"), (None, "en", "a"), (None, "en", "a")], SCHEMA)
    lm = NG.train_ngram_lm(d, 2)
    got = {r["doc_id"]: r["perplexity"] for r in NG.perplexity_ngram(d, lm).collect()}
    want = {r["doc_id"]: r["perplexity"] for r in NG._folded_positions(d, lm, "doc_id", ["lang"], "text", 6).collect()}
    assert got == want and got[1] != got[2]


def test_windows_move_once_and_lower_orders_come_from_the_order_above(spark):
    d = spark.createDataFrame([(i, "en", f"w{i} a b c w{i} a") for i in range(50)], SCHEMA)
    lm = NG.train_ngram_lm(d, 3)
    c = {(r["k"], r["ctx"], r["w"]): r["c"] for r in lm["counts"].collect()}
    assert c[1, "", "a"] == 100 and c[2, "a", "b"] == 50 and c[3, "<s> <s>", "w7"] == 1
    # counts are written grams: reading them scans no text (each order used to be unnested from the texts)
    assert "regexp_replace" not in lm["counts"]._jdf.queryExecution().toString()


def test_known_windows_need_no_lookup_of_their_parts(spark, monkeypatch):
    d = spark.createDataFrame(ROWS[:3], SCHEMA)
    w = KN.doc_windows(d)
    lm = KN.train_kn(w)
    lp = KN.window_probs(w, lm)
    want = {r["doc_id"]: r["p"] for r in w.join(lp, ["lang", "gram"]).groupBy("doc_id").agg(
        F.round(F.exp(-F.sum(F.col("n") * F.col("lp")) / F.sum("n")), 6).alias("p")).collect()}
    monkeypatch.setattr(KN, "window_probs", lambda *a: pytest.fail("every window is a gram of the model"))
    assert {r["doc_id"]: r["perplexity"] for r in KN.perplexity_kn(w, lm).collect()} == pytest.approx(want)


def test_bigram_perplexity_of_unseen_words_and_groups(spark):
    lm = NG.train_bigram_lm(spark.createDataFrame([(1, "en", "a b a")], SCHEMA))
    got = {r["doc_id"]: r["perplexity"] for r in NG.perplexity(spark.createDataFrame(
        [(1, "en", "a z"), (2, "fr", "a"), (3, None, "a")], SCHEMA), lm).collect()}
    # V = 4 (a, b, end, unknown): p(a|<s>) = 2/5, p(z|a) = 1/6, p(end|z) = 1/4
    assert got[1] == pytest.approx((2 / 5 * 1 / 6 * 1 / 4) ** (-1 / 3), abs=1e-5)
    assert got[2] == 1.0 and got[3] == 1.0

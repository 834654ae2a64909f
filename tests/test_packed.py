"""Texts as packed chunks: the same perplexities as the tables of the models, however chunks, buckets and heads are cut."""

import numpy as np
import pytest

from rankshift.operators import kneser_ney as KN
from rankshift.operators import ngram as NG
from rankshift.operators import packed
from rankshift.operators import tokens as TK

SCHEMA = "doc_id long, lang string, text string"


def _rows(n=40):
    r = np.random.default_rng(5)
    rows = [(i, ["en", "de"][i % 2], " ".join(f"w{int(x)}" for x in r.zipf(1.5, int(r.integers(0, 40))) % 30)) for i in range(n)]
    return rows + [(n, None, "w1 w2"), (n + 1, "en", None), (n + 2, "en", "-- W1, É w1!"), (n + 3, "es", "")]


ASKED = [(1, "en", "w1 w2 w1 new w3"), (2, "en", ""), (3, "fr", "w1"), (4, None, "w1"), (5, "de", "new new")]


def _got(df):
    return {r["doc_id"]: r["perplexity"] for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    """Many chunks and buckets, and heads in several buckets."""
    monkeypatch.setattr(packed, "HOT", 7)
    monkeypatch.setattr(packed, "GRAMS", 200)
    coded = packed.coded_texts
    monkeypatch.setattr(packed, "coded_texts", lambda df, key, by, text: coded(df, key, by, text, tokens=200))


def test_packed_numbers_come_back():
    a = np.array([0, 1, 255, 256, (1 << 40) + 3]), np.array([], np.int64), np.zeros(9, np.int64)
    assert all(np.array_equal(x, y) for x, y in zip(packed.unpack(packed.pack(*a)), a))


def test_kneser_ney_counts_chunks_and_makes_no_gram_table(spark, small, monkeypatch):  # F1
    d, asked = spark.createDataFrame(_rows(), SCHEMA), spark.createDataFrame(ASKED, SCHEMA)
    for order in (3,):
        w, a = KN.doc_windows(d, order=order), KN.doc_windows(asked, order=order)
        tables = {**KN._kn_tables(w, order, ["lang"]), "order": order}
        want = [_got(KN.perplexity_kn(x, tables)) for x in (w, a)]
        with monkeypatch.context() as m:
            m.setattr(KN, "adjusted_counts", lambda *x: pytest.fail("grams are counted as rows"))
            lm = KN.train_kn(w, order)
            assert [_got(KN.perplexity_kn(x, lm)) for x in (w, a)] == [pytest.approx(x, abs=2e-6) for x in want]


def test_trigrams_are_counted_in_chunks_and_make_no_table(spark, small, monkeypatch):  # F2
    d, asked = spark.createDataFrame(_rows(), SCHEMA), spark.createDataFrame(ASKED, SCHEMA)
    for order in (1, 3):
        tables = {**NG._ngram_tables(d, order, ["lang"], "text"), "order": order, "discount": 0.75}
        want = [_got(NG.perplexity_ngram(x, tables)) for x in (d, asked)]
        with monkeypatch.context() as m:
            m.setattr(NG, "window_rows", lambda *x: pytest.fail("windows are rows"))
            lm = NG.train_ngram_lm(d, order)
            assert [_got(NG.perplexity_ngram(x, lm)) for x in (d, asked)] == [pytest.approx(x, abs=2e-6) for x in want]


def test_bigrams_are_counted_in_chunks_and_make_no_table(spark, small, monkeypatch):  # F5, F7, F8, F9
    d, asked = spark.createDataFrame(_rows(), SCHEMA), spark.createDataFrame(ASKED, SCHEMA)
    counted = NG.doc_bigrams(d)
    tables = dict(NG.train_bigram_lm(d))
    want = [_got(NG.perplexity(d, tables)), _got(NG.perplexity(asked, tables))]
    monkeypatch.setattr(NG, "scored_windows", lambda *x: pytest.fail("a row for each bigram of a text"))
    lm = NG.train_bigram_lm(d, counted=counted)
    assert _got(NG.perplexity(d, lm, counted=counted)) == pytest.approx(want[0], abs=2e-6)
    assert _got(NG.perplexity(asked, lm)) == pytest.approx(want[1], abs=2e-6)
    assert _got(NG.perplexity(d, NG.train_bigram_lm(d))) == pytest.approx(want[0], abs=2e-6)


def test_a_changed_model_is_read_from_its_tables(spark):
    d = spark.createDataFrame(_rows(20), SCHEMA)
    lm = NG.train_bigram_lm(d)
    lm["bigrams"] = lm["bigrams"].where("w1 <> 'w1'")
    assert _got(NG.perplexity(d, lm)) == pytest.approx(_got(NG.perplexity(d, dict(lm))))


def test_texts_without_group_columns(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string")
    lm = NG.train_bigram_lm(d, by=())
    # V = 5; p(a|<s>) = 3/7, p(b|a) = 2/8, p(a|b) = 2/6, p(end|a) = 2/8
    assert _got(NG.perplexity(d, lm, by=()))[1] == pytest.approx((3 / 7 * 2 / 8 * 2 / 6 * 2 / 8) ** -0.25, abs=1e-6)


def test_whole_texts_are_encoded_and_decoded_by_the_words_of_a_chunk(spark, monkeypatch):  # F3
    rows = [(1, "b A b"), (2, "a zz c"), (3, ""), (4, None), (5, "b c"), (5, "c a b"), (None, "a"), (None, "c")]
    d = spark.createDataFrame(rows, "ord long, text string")
    v = spark.createDataFrame([("<pad>", 0), ("<unk>", 5), ("a", 7), ("b", 8), ("c", 9)], "tok string, id int")
    monkeypatch.setattr(TK, "_regroup", lambda *x: pytest.fail("a row for each word of a text"))
    ids = TK.encode(d, v)
    assert {r["ord"]: r["input_ids"] for r in ids.collect()} == {
        1: [8, 7, 8], 2: [7, 5, 9], 3: [], 4: [], 5: [8, 9, 7, 9, 8], None: [7, 9]}  # one key: by place, then id
    assert {r["ord"]: r["input_ids"] for r in TK.encode(d.where("ord = 1"), v, add_eos=True).collect()} == {1: [8, 7, 8, 3]}
    got = TK.decode(spark.createDataFrame([(1, [8, 7, -100, 99, 0, 9, None]), (2, []), (3, None), (4, [9, 7]), (4, [8, 7])],
                                          "ord long, input_ids array<int>"), v)
    assert {r["ord"]: r["text"] for r in got.collect()} == {1: "b a c", 2: "", 3: "", 4: "b c a a"}

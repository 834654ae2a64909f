"""Alias tables, sampled and beam texts, the pluggable generator slot, the Kneser-Ney model."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rankshift.operators import generate as G
from rankshift.operators import kneser_ney as KN
from rankshift.operators import sampling as SA
from rankshift.operators.generators import CycleGenerator
from rankshift.operators.ngram import train_bigram_lm
from rankshift.params import GenParams
from rankshift.plans import standins
from rankshift.sources.tables import table

CUTS = [{}, {"top_p": 0.9}, {"temperature": 1.5, "top_p": 0.8}, {"top_k": 3}]


@pytest.fixture(scope="module")
def counts(spark):
    d = table(spark, SF001, "documents").select("lang", "text")
    return train_bigram_lm(d, by=("lang",))["bigrams"].cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("cut", CUTS)
def test_cells_hold_every_weight_and_do_not_depend_on_the_way(monkeypatch, counts, cut):
    key = ["lang", "ctx"]
    cells, contexts = SA.alias_table(counts, ["lang"], **cut)
    lists, _ = SA.continuations(counts, ["lang"], **cut)
    shares = (cells.select(*key, F.col("own").alias("w"), F.col("t").alias("m"))
              .unionAll(cells.select(*key, "other", F.col("total") - F.col("t"))).groupBy(*key, "w").agg(F.sum("m").alias("m")))
    wrong = shares.join(lists, [*key, "w"], "full").where("m is null and x is not null or m <> coalesce(n * x, 0)")
    assert wrong.count() == 0 and cells.where("t < 0 or t > total").count() == 0
    assert contexts.count() == lists.select(*key).distinct().count()
    monkeypatch.setattr(SA, "HOT", 2)  # nearly all contexts by joins instead of windows
    assert rows(SA.alias_table(counts, ["lang"], **cut)[0]) == rows(cells)
    assert rows(SA.continuations(counts, ["lang"], **cut)[0]) == rows(lists)


@pytest.mark.parametrize("beams", [1, 2])
def test_texts_follow_the_model_at_any_partitioning(spark, counts, beams):
    pairs = counts.groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    follows = {(r["w1"], r["w2"]) for r in pairs.collect()}
    q = standins.queries(spark, SF001)
    p = GenParams(num_beams=beams, temperature=0.9, top_p=0.95, max_length=6, seed=5).to_dict()
    a = rows(SA.sample_texts(q, pairs, p, cut_every=3))
    b = rows(SA.sample_texts(q.repartition(7), pairs.repartition(3), p, cut_every=50))
    assert a == b and len(a) == q.count()
    assert all(pair in follows for text, _ in a for pair in zip(text.split(), text.split()[1:]))


@pytest.mark.parametrize("params", [{"top_p": 0.9}, {"do_sample": False}, {"num_beams": 2, "temperature": 1.5},
                                    {"num_beams": 3, "do_sample": False, "top_p": 1.0}])
def test_tables_built_on_the_way_give_the_same_texts(monkeypatch, spark, counts, params):
    q = spark.createDataFrame([(1, "zzz unseen"), (2, None), (3, "x")], "qid long, query string")
    pairs = counts.groupBy("w1", "w2").agg(F.sum("c").alias("c")).cache()
    p = GenParams(max_length=3, seed=5).to_dict() | params
    whole = rows(SA.sample_texts(q, pairs, p))
    built, add = [], SA._Tables._add
    monkeypatch.setattr(SA._Tables, "_add", lambda self, df: (add(self, df), built.append(self.heads.select("ctx").collect())))
    monkeypatch.setattr(SA, "WHOLE", 0)
    assert rows(SA.sample_texts(q, pairs, p)) == whole
    met = [r["ctx"] for r in built[-1]]
    assert len(met) == len(set(met)) and 0 < len(met) < pairs.select("w1").distinct().count()  # each once, only those met


def test_odd_prompts_and_empty_model(spark, counts):
    q = spark.createDataFrame([(1, None), (2, ""), (3, "zzz unseen"), (4, "!?"), (None, "x")], "qid long, query string")
    p = GenParams(max_length=4).to_dict()
    pairs = counts.groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    assert SA.sample_texts(q, pairs, p).where("generated_text is null").count() == 0
    for beams in (1, 3):
        none = SA.sample_texts(q, pairs.limit(0), p | {"num_beams": beams})
        assert sorted(r["generated_text"] for r in none.collect()) == [""] * 5
        assert SA.sample_texts(q.limit(0), pairs, p | {"num_beams": beams}).count() == 0


def plain_beams(model, start, beams, length):
    live, done = [(0.0, start, [], 1)], []
    for _ in range(length):
        found = [(s + math.log(c / sum(model[ctx].values())), b, w, gen) for s, ctx, gen, b in live for w, c in model[ctx].items()]
        found = sorted(found, key=lambda x: (-round(x[0], 9), x[1], x[2]))[:2 * beams]
        live = []
        for r, (s, b, w, gen) in enumerate(found):
            if w == "</s>":
                done += [(s / (len(gen) + 1), gen)] if r < beams else []
            elif len(live) < beams:
                live.append((s, w, gen + [w], len(live) + 1))
    done += [(s / max(1, len(gen)), gen) for s, _, gen, _ in live]
    return max(done, key=lambda x: round(x[0], 9))[1]


def test_beam_search_equals_plain(spark):
    texts = ["a b c a b d", "a b c e", "b c a d d e", "c e a b", "f a b c c c"]
    counts = train_bigram_lm(spark.createDataFrame([(t,) for t in texts], "text string"), by=())["bigrams"]
    model = {}
    for r in counts.collect():
        model.setdefault(r["w1"], {})[r["w2"]] = r["c"]
    q = spark.createDataFrame([(i, w) for i, w in enumerate("abcdef")], "qid long, query string")
    for beams in (2, 4):
        p = GenParams(do_sample=False, num_beams=beams, top_p=1.0, max_length=5).to_dict()
        got = {r["qid"]: r["generated_text"] for r in SA.sample_texts(q, counts, p).collect()}
        assert got == {i: " ".join(plain_beams(model, w, beams, 5)) for i, w in enumerate("abcdef")}


def test_pluggable_generator(spark):
    q = standins.queries(spark, SF001)
    a, b = (G.generate(x, CycleGenerator, GenParams(max_length=5)) for x in (q, q.repartition(3)))
    assert rows(a) == rows(b) and a.where("size(split(generated_text, ' ')) = 5").count() == q.count()


def test_kneser_ney_is_a_distribution(spark):
    texts = [(1, "en", "a b c a b d a b"), (2, "en", "b c a d"), (3, "en", "c c c e"), (4, "de", "x y"), (5, "de", None), (6, None, "q")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    w = KN.doc_windows(docs)
    lm = KN.train_kn(w)
    words = ["a", "b", "c", "d", "e", "</s>", "never"]
    for ctx in ("<s>", "<s> b", "a b", "b c", "c c", "d a", "zz a", "zz zz"):
        asked = spark.createDataFrame([("en", f"{ctx} {x}") for x in words], "lang string, gram string")
        total = sum(math.exp(r["lp"]) for r in KN.window_probs(asked, lm).collect())
        assert total == pytest.approx(1.0)  # "never" stands for the one unknown word
    got = {r["doc_id"]: r["perplexity"] for r in KN.perplexity_kn(w, lm).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[6] is None and all(got[i] > 0 for i in (1, 2, 3, 4, 5))
    assert KN.perplexity_kn(w.limit(0), lm).count() == 0

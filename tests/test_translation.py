"""The learned pair scorer against a plain version and against word overlap."""

import math
import random

import pytest

from rankshift.operators import translation as TR
from rankshift.operators.generators import overlap_scorer


def plain(pairs, rounds):
    t = None
    for _ in range(rounds):
        c = {}
        for q, d in pairs:
            for x in q.split():
                ds = ["", *d.split()]
                total = sum(1.0 if t is None else t.get((x, y), 0) for y in ds)
                for y in ds:
                    c[x, y] = c.get((x, y), 0) + (1.0 if t is None else t.get((x, y), 0)) / total
        s = {}
        for (_, y), v in c.items():
            s[y] = s.get(y, 0) + v
        t = {k: v / s[k[1]] for k, v in c.items()}
    return t


def made(rng, n):
    words = [rng.sample(range(30), 3) for _ in range(n)]
    return [(" ".join(f"q{w}" for w in ws), " ".join([f"a{w}" for w in ws] + [f"n{rng.randrange(9)}"] * 2)) for ws in words]


def test_table_scores_and_held_out_ranks(spark):
    rng = random.Random(6)
    pairs, held = made(rng, 300), made(rng, 40)
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(pairs)], "ord long, query string, body string")
    model = TR.train_translation(TR.word_pairs(df.repartition(5)), 4, keep=0.0)
    t = {(r["q"], r["d"]): r["t"] for r in model["table"].collect()}
    want = plain(pairs, 4)
    assert set(t) == set(want) and all(t[k] == pytest.approx(want[k]) for k in want)

    rows = [(i, j, held[(i + j) % len(held)][1] if j else a, 0) for i, (_, a) in enumerate(held) for j in range(8)]
    rows += [(i, 8, None, 0) for i in range(len(held))]
    lists = spark.createDataFrame(rows, "qid long, idx long, text string, label int")
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(held)] + [(900, "zz"), (901, None)], "qid long, query string")
    got = {(r["qid"], r["idx"]): r["score"] for r in TR.score_translation(lists, queries, model).collect()}
    n = sum(len(q.split()) for q, _ in pairs)
    p = {}
    for q, _ in pairs:
        for w in q.split():
            p[w] = p.get(w, 0) + 1
    for i, j, text, _ in rows:
        d = (text or "").split()
        s = sum(math.log(0.5 * (p.get(w, 0) + 1) / (n + len(p) + 1) + 0.5 * (want.get((w, ""), 0) + sum(want.get((w, x), 0) for x in d)) / (len(d) + 1))
                for w in held[i][0].split())
        assert got[i, j] == pytest.approx(s, abs=2e-6)
    best = sum(max(range(9), key=lambda j: got[i, j]) == 0 for i in range(len(held)))
    import pandas as pd
    over = overlap_scorer(pd.Series([held[i][0] for i, *_ in rows]), pd.Series([x or "" for _, _, x, _ in rows]))
    assert best >= 0.9 * len(held) and over.max() == 0  # no word is shared: overlap cannot tell them apart


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ord long, query string, body string")
    model = TR.train_translation(TR.word_pairs(none), 2)
    lists = spark.createDataFrame([(1, 0, "a b", 0), (1, 1, None, 0)], "qid long, idx long, text string, label int")
    q = spark.createDataFrame([(1, "a")], "qid long, query string")
    assert TR.score_translation(lists, q, model).count() == 2
    assert TR.score_translation(lists.limit(0), q, model).count() == 0


def test_embedder_slot_equals_hashed_cosine(spark):
    from rankshift.operators import rank
    from rankshift.operators.generators import hashing_embedder
    lists = spark.createDataFrame([(1, 0, "a b b c", 0), (1, 1, "", 0), (1, 2, None, 0), (2, 0, "b é x", 1), (2, 1, "q", -1)],
                                  "qid long, idx long, text string, label int")
    q = spark.createDataFrame([(1, "b c"), (2, "x b b zz")], "qid long, query string")
    sparse = rank.hashed_cosine_from_terms(rank.list_terms(lists), rank.query_terms(q), dim=16)
    docs, asked = rank.embed_with(lists, hashing_embedder(16)), rank.embed_with(q, hashing_embedder(16), "query", "qvec")
    dense = rank.score_vectors(docs.select("qid", "idx", "embedding"), asked.select("qid", "qvec"), ["qid"])
    got, want = ({(r["qid"], r["idx"]): r["score"] for r in x.collect()} for x in (sparse, dense))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_small_blocks_own_words_and_parts_of_lists(spark):
    rng = random.Random(8)
    pairs = [(f"all {q} {q.split()[0]}", f"{a} {a.split()[0]}") for q, a in made(rng, 120)] + [("all", ""), ("", "a1"), (None, "a2"), ("q1", None)]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(pairs)], "ord long, query string, body string")
    links = TR.word_pairs(df.repartition(3))
    assert links.count() == sum(1 for q, _ in pairs if q)  # one row a pair, not one a question word and answer word
    models = [TR.train_translation(links, 3, keep=0.0, block=b) for b in (100, 10**6)]
    want = plain([(q or "", a or "") for q, a in pairs], 3)
    for m in models:  # in blocks of 100 the word of all questions has a block of its own, cut into parts
        rows = m["table"].collect()
        assert len(rows) == len(want) and all(r["t"] == pytest.approx(want[r["q"], r["d"]]) for r in rows)
    only = spark.createDataFrame([("a1",), ("zz",)], "d string")
    assert {(r["q"], r["ds"]) for r in models[0]["table_of"](only).collect()} == {k for k in want if k[1] == "a1"}

    # a repeated idx counts as one text of all its words; null idx and null lists have no words in common with a query
    lists = spark.createDataFrame([(j % 2, j, a, 0) for j, (_, a) in enumerate(pairs)] + [(0, 2, "a1 a2", 0), (0, None, "a1", 0), (None, 1, "a1", 0)],
                                  "qid long, idx long, text string, label int")
    q = spark.createDataFrame([(0, "all q1 q1 zz"), (1, "q2"), (None, "q3")], "qid long, query string")
    one, cut = (sorted(map(str, TR.score_translation(lists, q, m, block=b).collect())) for m, b in zip(models, (50, 10**6)))
    assert one == cut and len(one) == len(pairs) + 3

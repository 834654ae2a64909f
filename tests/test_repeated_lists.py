"""Lists that repeat for every run are scored from one copy of their terms."""

from rankshift.operators import rank
from rankshift.plans import evaluation

CANDS = [(0, 1, "a b c", 1), (0, 2, "b b d", 0), (0, 3, "", 0), (0, 3, "a d", 1), (1, 4, None, 0), (None, 5, "a", 1)]
QUERIES = [(0, "a b q"), (1, "z"), (2, "a"), (None, "a")]
GEN = [(0, "r1", "a b new"), (0, "r2", None), (0, "r2", "b q q"), (1, "r1", "z z"), (2, "r1", "a a"), (None, "r1", "a")]


def test_repeated_lists_score_as_copies_and_no_copy_is_written(spark, monkeypatch):
    c = spark.createDataFrame(CANDS, "qid long, idx long, text string, label int")
    q = spark.createDataFrame(QUERIES, "qid long, query string")
    g = spark.createDataFrame(GEN, "qid long, run string, text string")
    keys = ["run", "qid"]
    asked = q.join(g.select("qid", "run").distinct(), "qid")
    want = evaluation.scored_lists(rank.with_fake(c, g, keys), asked, keys)
    want = rank.fake_positions(want, ["ranker", *keys])
    sizes, terms = [], rank.list_terms
    monkeypatch.setattr(rank, "list_terms", lambda d, *a: sizes.append(d.count()) or terms(d, *a))
    got = evaluation.fake_positions_for(c, q, g, keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert sum(sizes) == len(CANDS) + len(GEN)  # copies for each run used to be tokenized and written

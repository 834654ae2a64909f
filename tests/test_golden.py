"""Golden values from the reference's printed outputs and FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from rankshift.operators import rank, tokens as TK
from rankshift.operators.metrics import position_summary, rank_metrics
from rankshift.operators.generate import strip_prompt
from rankshift.streaming.settings import WORD_MAX, WORD_MIN, parse_word_count


def _sample_b(spark):
    # 2 queries x 6 documents (fake = idx 5, label -1). Positions of the fake:
    # LaBSE {3, 6}, Bm25 {1, 5}.  Relevant document at position 4 in the query
    # with the better fake, above the fake in the other.
    rows = []

    def add(ranker, qid, fake_pos, rel_pos):
        others = [p for p in range(1, 7) if p != fake_pos]
        for i, p in enumerate(others):
            label = 1 if p == rel_pos else 0
            rows.append((ranker, qid, i, label, float(10 - p)))
        rows.append((ranker, qid, 5, -1, float(10 - fake_pos)))

    add("LaBSE", 0, 3, 4)
    add("LaBSE", 1, 6, 1)
    add("Bm25", 0, 1, 4)
    add("Bm25", 1, 5, 2)
    return spark.createDataFrame(rows, "ranker string, qid long, idx long, label int, score double")


def test_sample_b_metrics(spark):
    pos = rank.fake_positions(_sample_b(spark), ["ranker", "qid"])
    got = {r["ranker"]: r.asDict() for r in rank_metrics(pos, ["ranker"]).collect()}
    assert got["LaBSE"]["avg_loc"] == 4.5 and got["Bm25"]["avg_loc"] == 3.0
    assert got["LaBSE"]["avg_rel_loc"] == 0.75 and got["Bm25"]["avg_rel_loc"] == 0.5
    assert (got["LaBSE"]["top_1"], got["LaBSE"]["top_3"], got["LaBSE"]["top_5"]) == (0.0, 0.5, 0.5)
    assert (got["Bm25"]["top_1"], got["Bm25"]["top_3"], got["Bm25"]["top_5"]) == (0.5, 0.5, 1.0)
    for r in ("LaBSE", "Bm25"):
        assert got[r]["fdaro_v1"] == 0.5 and got[r]["fdaro_v2"] == 0.5
        assert got[r]["up_quartile"] == 0.5


def test_position_summary_sample_b(spark):
    pos = rank.fake_positions(_sample_b(spark), ["ranker", "qid"])
    got = {r["ranker"]: r for r in position_summary(pos, ["ranker"]).collect()}
    assert got["LaBSE"]["median_loc"] == 4.5
    assert got["Bm25"]["median_pct_better"] == pytest.approx((0.0 + 0.8) / 2)
    whole = position_summary(pos, []).collect()[0]
    assert whole["median_loc"] == 4.0


def test_ties_fake_loses(spark):
    df = spark.createDataFrame([("r", 0, 0, 0, 1.0), ("r", 0, 1, 0, 1.0), ("r", 0, 2, -1, 1.0)],
                               "ranker string, qid long, idx long, label int, score double")
    assert rank.fake_positions(df, ["ranker", "qid"]).first()["loc"] == 3


@pytest.mark.parametrize("end,expected", [("exclusive", [0, 0, 0, 1, 1, 2]), ("inclusive", [0, 0, 1, 1, 2, 2])])
def test_block_counts(spark, end, expected):
    lens = [0, 3, 4, 5, 8, 9]
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate(lens)], "ord long, input_ids array<int>")
    blocks = TK.cut_blocks(df, 4, end=end).groupBy("ord").count().collect()
    counts = {r["ord"]: r["count"] for r in blocks}
    assert [counts.get(i, 0) for i in range(len(lens))] == expected


def test_edit_distance_and_letters(spark):
    from rankshift.functions.text import letter_count
    r = spark.range(1).select(F.levenshtein(F.lit("ñandú"), F.lit("nandu")).alias("a"),
                              F.levenshtein(F.lit("abcdef"), F.lit("zzzzzz"), 2).alias("b"),
                              letter_count(F.lit("añ1 b")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (2, -1, 3)


def test_settings_values():
    vals = ["9", "10", "1023", "1024", "abc", "185.22"]
    ok = [(parse_word_count(v) is not None and WORD_MIN <= parse_word_count(v) <= WORD_MAX) for v in vals]
    assert ok == [False, True, True, False, False, False]
    assert parse_word_count("1_000") is None


def test_prompt_strip(spark):
    df = spark.createDataFrame([(0, "abc", "abcdef"), (1, "abc", "xyzdef"), (2, "abc", "ab")],
                               "id int, query string, text string")
    got = [r["text"] for r in strip_prompt(df).orderBy("id").collect()]
    assert got == ["def", "def", ""]
    checked = [r["text"] for r in strip_prompt(df, check=True).orderBy("id").collect()]
    assert checked == ["def", "xyzdef", "ab"]

"""Edge cases: empty/null texts, lists with one candidate, no relevant
document, empty fake, ties; small helpers."""

import json

from pyspark.sql import functions as F

from rankshift.operators import prep, rank, tokens as TK
from rankshift.operators.metrics import rank_metrics
from rankshift.params import EvalParams
from rankshift.plans import evaluation, runs
from rankshift.sources import sinks


def _case(spark):
    cands = spark.createDataFrame([
        (0, 0, "red apple pie", 1), (0, 1, "", 0), (0, 2, None, 0), (0, 3, "apple apple", 0),
        (1, 10, "lonely candidate", 0),
        (2, 20, "x y", 0), (2, 21, "x y", 0),
    ], "qid long, idx long, text string, label int")
    queries = spark.createDataFrame([(0, "apple pie"), (1, "candidate"), (2, "")], "qid long, query string")
    gen = spark.createDataFrame([(0, "apple pie"), (1, ""), (2, "x y")], "qid long, text string")
    return cands, queries, gen


def test_positions_edges(spark):
    cands, queries, gen = _case(spark)
    pos = evaluation.fake_positions_for(cands, queries, gen, materialize_positions=False)
    got = {(r["ranker"], r["qid"]): r for r in pos.collect()}
    assert got[("Bm25", 1)]["n"] == 2 and got[("Bm25", 1)]["loc"] == 2       # empty fake scores 0, loses tie
    assert got[("Bm25", 2)]["loc"] == 3                                       # empty query: all 0, fake last
    assert got[("Bm25", 0)]["n"] == 5 and got[("Bm25", 0)]["n_rel"] == 1
    m = {r["ranker"]: r for r in rank_metrics(pos).collect()}
    assert m["Bm25"]["fdaro_v2"] is not None


def test_incremental_edges(spark):
    cands, queries, gen = _case(spark)
    g2 = gen.withColumn("run", F.lit("r1")).unionByName(
        gen.withColumn("run", F.lit("r2")).withColumn("text", F.lit("apple")))
    inc = runs.run_positions(cands, queries, g2)
    direct = evaluation.fake_positions_for(cands, queries, g2, ["run", "qid"], materialize_positions=False)
    cols = ["ranker", "run", "qid", "n", "loc", "n_rel", "n_rel_above"]
    assert sorted(map(tuple, inc.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))


def test_model_columns_and_restore_pad(spark):
    df = spark.createDataFrame([(1, "q", "b", 3, "x")], "ord long, query string, body string, label int, url string")
    assert prep.model_columns(df, "made_data").columns == ["ord", "query", "body", "label"]
    ids = spark.createDataFrame([(1, [5, -100, 7])], "ord long, labels array<int>")
    assert ids.select(TK.restore_pad("labels", 0).alias("x")).first()["x"] == [5, 0, 7]


def test_run_params_written(spark, tmp_path):
    p = EvalParams(launch_description="exp")
    rid = sinks.run_id(p.launch_description)
    sinks.write_run_params(spark, str(tmp_path / "runs"), rid, p.to_dict())
    row = spark.read.parquet(str(tmp_path / "runs")).first()
    assert row["run_id"] == rid and json.loads(row["params"])["generator"] == "echo"


def test_teacher_table_keeps_labels(spark):
    rows = spark.createDataFrame(
        [(1, "q one", ([0, 1], ["p zero", "p one"]))],
        "ord long, query string, passages struct<is_selected: array<int>, passage_text: array<string>>")
    v = TK.build_vocab(rows.select(F.split(F.lit("q one p zero"), " ").alias("tokens")))
    t = TK.training_table(rows, v, "part_data", "teacher", max_len=4).first()
    eos = TK.SPECIAL.id("eos")
    assert t["pos_label"] == [0, 1] and len(t["input_ids"]) == 4 and t["input_ids"][0] == 0 and eos not in t["labels"]
    t5 = TK.training_table(rows, v, "part_data", "teacher", max_len=4, target_len=6, family="t5").first()
    assert len(t5["input_ids"]) == 4 and len(t5["labels"]) == 6 and eos in t5["labels"]
    only = TK.training_table(rows, v, "part_data", "teacher", max_len=4, family="t5", split="validation")
    assert only.columns == ["ord", "input_ids"]


def test_site_table_without_key(spark):
    from rankshift.operators import clean as C
    pages = spark.createDataFrame([(1, "https://a.site.org/x"), (2, "http://other.net"), (3, "http://site.org:80/")],
                                  "page_id long, url string")
    hosts = spark.createDataFrame([("site.org",)], "site string")
    assert sorted(r["page_id"] for r in C.on_sites(pages, hosts).collect()) == [1, 3]
    assert sorted(r["page_id"] for r in C.on_sites(pages, ["site.org"]).collect()) == [1, 3]


def test_external_tokenizer_slot(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, "")], "ord long, text string")

    def enc(texts):  # stand-in for a BPE encoder: one id per character code
        return [[ord(ch) for ch in t] for t in texts]

    got = {r["ord"]: r["input_ids"] for r in TK.encode_external(df, enc, max_len=3, pad=True).collect()}
    assert got == {1: [97, 98, 32], 2: [0, 0, 0]}


def test_term_counts_long_document_linear(spark):
    import time
    words = " ".join(f"w{i % 3000}" for i in range(20000))
    df = spark.createDataFrame([(0, 0, words, 0), (0, 1, "w1 w1 w2", 1)], "qid long, idx long, text string, label int")
    t = time.time()
    rows = rank.list_terms(df, ["qid"]).collect()
    assert time.time() - t < 60
    tf = {(r["idx"], r["tok"]): r["tf"] for r in rows}
    assert tf[(1, "w1")] == 2 and tf[(1, "w2")] == 1
    assert len([k for k in tf if k[0] == 0]) == 3000 and tf[(0, "w0")] == 7
    assert {r["dl"] for r in rows if r["idx"] == 0} == {20000}

"""Evaluation runs from parameters, sinks that grow, training tables at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rankshift.operators import clean as C
from rankshift.operators import tokens as TK
from rankshift.operators.ngram import train_bigram_lm
from rankshift.params import EvalParams, GenParams
from rankshift.plans import evaluation, standins
from rankshift.sources import sinks
from rankshift.sources.tables import table


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_models_and_runs_grow(spark, tmp_path):
    path = str(tmp_path / "by_model")
    one = spark.createDataFrame([("m1", "a"), ("m2", "b")], "model string, text string")
    sinks.write_by_model(one, path)
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "by_model").rglob("*.json")}
    sinks.write_by_model(spark.createDataFrame([("m3", "c")], "model string, text string"), path)
    assert rows(spark.read.json(path), "model", "text") == [("m1", "a"), ("m2", "b"), ("m3", "c")]
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    sinks.write_by_model(spark.createDataFrame([("m1", "z")], "model string, text string"), path)
    assert rows(spark.read.json(path), "model", "text") == [("m1", "z"), ("m2", "b"), ("m3", "c")]
    ex = spark.createDataFrame([("q", "t")], "query string, generated_text string")
    for run in ("r1", "r2", "r1"):
        sinks.write_examples(ex, str(tmp_path / "examples"), run)
        sinks.write_run_params(spark, str(tmp_path / "runs"), run, {"k": run})
    assert rows(spark.read.json(str(tmp_path / "examples")), "run_id", "query") == [("r1", "q"), ("r2", "q")]
    assert rows(spark.read.parquet(str(tmp_path / "runs")), "run_id") == [("r1",), ("r2",)]


def test_replayed_micro_batch_writes_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "query string, generated_text string"
    spark.createDataFrame([(f"q{i}", "t") for i in range(5)], schema).coalesce(1).write.parquet(src)

    def run():
        sinks.stream_examples(spark.readStream.schema(schema).parquet(src), out, "r", ckpt).awaitTermination()

    run()
    # a driver that died before it could note the end of batch 0
    for done in (tmp_path / "ckpt" / "commits").glob("*"):
        if done.name in ("0", ".0.crc"):
            done.unlink()
    run()
    assert len(rows(spark.read.json(out), "query")) == 5
    spark.createDataFrame([("new", "t")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert len(rows(spark.read.json(out), "query")) == 6


@pytest.mark.parametrize("generator", ["echo", "extractive", "ngram"])
def test_evaluate_run(spark, tmp_path, generator):
    q, c = standins.queries(spark, SF001), standins.candidates(spark, SF001)
    params = EvalParams(launch_description="t", generator=generator, total_samples=7, ks=(2, 3), strip_prompt=generator == "echo",
                        batch_size=3, number_examples_batch=2, gen=GenParams(num_beams=2, max_length=4))
    grams = train_bigram_lm(table(spark, SF001, "documents").select("text"), by=())["bigrams"] if generator == "ngram" else None
    for _ in range(2):  # the same run again replaces its results
        assert evaluation.evaluate_run(q, c, params, str(tmp_path), "run1", grams) == "run1"
    record = [json.loads(r["metrics"]) for r in spark.read.json(str(tmp_path / "metrics")).collect()]
    assert len(record) == 1 and {"Bm25_AverageLoc", "TfCosine_Top@2"} <= set(record[0])
    examples = spark.read.json(str(tmp_path / "examples"))
    first = {r["query"] for r in q.orderBy("qid").limit(7).collect()}
    assert {r["query"] for r in examples.collect()} <= first and 0 < examples.count() <= 6
    used = json.loads(spark.read.parquet(str(tmp_path / "runs")).where("run_id = 'run1'").first()["params"])
    assert used["total_samples"] == 7 and used["gen"]["num_beams"] == 2
    with pytest.raises(NotImplementedError):
        evaluation.generated(q, c, EvalParams(generator="none"))


def test_short_labelled_texts_give_blocks(spark):
    rows_ = [(0, "q", "a b"), (1, "q", " ".join("cdefgh")), (2, None, None), (3, "q", " ".join(["w"] * 30))]
    df = spark.createDataFrame(rows_, "ord long, query string, body string").withColumn("label", F.lit(3))
    v = TK.build_vocab(C.with_tokens(TK.clm_text_pairs(df)))
    for special, blank in ((TK.SPECIAL, slice(-1, None)), (TK.GPT_SPECIAL, slice(0, 1))):
        t = TK.training_table(df, v, "made_data", "clm", block=4, context=12, special=special)
        got = {}
        for r in t.orderBy("ord", "block").collect():
            got.setdefault(r["ord"], []).append(r["input_ids"])
        # 12 ids give blocks at 0 and 4 (the last start is below 12 - 4); longer texts are not cut
        assert [len(got[i]) for i in (0, 1, 2)] == [2, 2, 2] and len(got[3]) > 2
        assert got[2][0] == [0] * 3 + got[2][0][3:] or got[2][0][blank] == [0]
    assert TK.training_table(df, v, "made_data", "clm", block=4).where("ord = 0").count() == 0
    raw = df.select("ord", F.col("query").alias("url"), "query", F.col("body").alias("text"))
    full = TK.training_table(raw, v, "full_data", block=5)
    assert [r["block"] for r in full.orderBy("block").collect()] == list(range(full.count())) and full.count() == 8

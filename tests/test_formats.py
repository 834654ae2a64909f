"""Readers and sinks on small files shaped like the reference inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rankshift.operators import prep, tokens as TK
from rankshift.sources import readers, sinks

ROW = {"query": "q one", "query_id": 1, "query_type": "DESCRIPTION", "answers": ["a"], "wellFormedAnswers": [],
       "passages": {"is_selected": [0, 1], "passage_text": ["p0", "p1"]}}


def test_jsonl_tok5_snk2(spark, tmp_path):
    p = tmp_path / "val.jsonl"
    p.write_text(json.dumps(ROW) + "\n" + json.dumps({**ROW, "query": "q two", "query_id": 2}) + "\n")
    df = readers.read_qa_jsonl(spark, str(p))
    texts = [r["text"] for r in TK.clm_text_passages(df).orderBy("ord").collect()]
    assert texts[0] == "p0q onep1"
    lines = [r["value"] for r in sinks.selected_text(df).orderBy("ord").collect()]
    assert lines[0] == "q one p1 </s>"


def test_json_array_validation_only(spark, tmp_path):
    p = tmp_path / "val.json"
    p.write_text(json.dumps([ROW, {**ROW, "query_id": 5}]))
    df = readers.read_qa_json(spark, str(p))
    assert df.count() == 2
    with pytest.raises(NotImplementedError):
        readers.read_qa_json(spark, str(p), "train")


def test_load_dispatch_errors(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        readers.load(spark, "unknown_kind", str(tmp_path))
    with pytest.raises(NotImplementedError):
        readers.load(spark, "made_valid_data", str(tmp_path), "train")


def test_csv_multiline(spark, tmp_path):
    p = tmp_path / "filtred_df.csv"
    p.write_text('query,url,title,meta,body,qlinks,label\n"q, a",http://x.ru/a,t,m,"line1\nline2",,3\n'
                 'q2,http://y.ru,t,m,b2,,1\n')
    df = readers.load(spark, "made_data", str(tmp_path), "train")
    rows = df.orderBy("ord").collect()
    assert rows[0]["body"] == "line1\nline2" and rows[0]["query"] == "q, a" and rows[0]["label"] == 3
    txt = sinks.pairs_text(df).orderBy("ord").first()["value"]
    assert txt == "q, a <sep> line1\nline2 </s>"


def test_tsv_gz_and_text_order(spark, tmp_path):
    import gzip
    p = tmp_path / "dataset.tsv.gz"
    with gzip.open(p, "wt") as f:
        f.write("http://a\tq1\tt1\nhttp://b\tq2\tt2\n")
    df = readers.load(spark, "full_data", str(tmp_path), "train")
    assert [r["query"] for r in df.orderBy("ord").collect()] == ["q1", "q2"]
    t = tmp_path / "corpus"
    os.makedirs(t)
    (t / "a.txt").write_text("first\nsecond\n")
    (t / "b.txt").write_text("third\n")
    lines = [r["text"] for r in readers.read_text_corpus(spark, str(t)).orderBy("ord").collect()]
    assert lines == ["first", "second", "third"]


def test_head_n_and_drop_non_text(spark):
    df = spark.createDataFrame([(i, None if i == 1 else f"t{i}") for i in range(10)], "ord long, text string")
    first = prep.head_n(df, 3)
    assert sorted(r["ord"] for r in first.collect()) == [0, 1, 2]
    assert prep.drop_non_text(first, ["text"]).count() == 2
    dense = prep.head_n(df.repartition(2), 3)
    assert sorted(r["ord"] for r in dense.collect()) == [0, 1, 2]


def test_write_metrics_record(spark, tmp_path):
    rec = spark.createDataFrame([("Bm25_avg_loc", 1.5), ("LaBSE_top_1", 0.25)], "name string, value double")
    sinks.write_metrics(rec, str(tmp_path / "m"), "eval_01-01-2026-10-00")
    back = spark.read.json(str(tmp_path / "m")).first()
    assert json.loads(back["metrics"]) == {"Bm25_avg_loc": 1.5, "LaBSE_top_1": 0.25}
    assert sinks.run_id("x").startswith("x_")
    assert F is not None

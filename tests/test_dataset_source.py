"""The dataset kinds as one data source: block borders, shapes, errors."""

import gzip
import json

import pytest

from rankshift.sources import dataset
from rankshift.sources.dataset import DatasetReader, read_dataset

ROWS = [{"query": f"q {i}" + "ü" * (i % 7), "query_id": i, "passages": {"is_selected": [0, 1][: i % 3], "passage_text": ["p\n\"x\"", "é"][: i % 3]}}
        for i in range(50)] + [{"query": None, "passages": None}]


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("ord").select(*cols).collect()]


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_json_lines_at_any_block_size(spark, tmp_path, block):
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(ROWS)))
    want = [(r["query"], (r["passages"] or {}).get("passage_text"), (r["passages"] or {}).get("is_selected")) for r in ROWS]
    plan = DatasetReader("part_data", "train", str(tmp_path), block).partitions()
    assert len(plan) == -(-plan[-1].end // block)
    if block == 1:  # one partition a byte: read here, not as thousands of tasks
        reader = DatasetReader("part_data", "train", str(tmp_path), block)
        got = [r for part in plan for b in reader.read(part) for r in b.to_pylist()]
        assert [(r["query"], r["passages"], r["is_selected"]) for r in got] == want
        assert [r["ord"] for r in got] == sorted({r["ord"] for r in got})
    else:
        assert rows(read_dataset(spark, "part_data", str(tmp_path), block_bytes=block), "query", "passages", "is_selected") == want


def test_other_kinds_share_the_shape(spark, tmp_path):
    (tmp_path / "val.json").write_text(json.dumps(ROWS))
    (tmp_path / "filtred_df.csv").write_text('query,url,title,meta,body,qlinks,label\n"q, a",http://x/a,t,m,"l1\nl2 ""z""",,3\n'
                                             'q2,,,,"",,1\n')
    with gzip.open(tmp_path / "dataset.tsv.gz", "wt") as f:
        f.write("".join(f"http://a/{i}\tq\"{i}\tt é{i}\n" for i in range(300)))
    nested = read_dataset(spark, "made_valid_data", str(tmp_path), "validation")
    assert [r[0] for r in rows(nested, "query")] == [r["query"] for r in ROWS]
    labelled = [read_dataset(spark, "made_data", str(tmp_path), s) for s in ("train", "validation")]
    for df in labelled:
        assert rows(df, "query", "url", "title", "body", "label") == [
            ("q, a", "http://x/a", "t", 'l1\nl2 "z"', 3), ("q2", None, None, "", 1)]
    raw = read_dataset(spark, "full_data", str(tmp_path), block_bytes=100)
    assert rows(raw, "url", "query", "body") == [(f"http://a/{i}", f'q"{i}', f"t é{i}") for i in range(300)]
    assert len({df.schema.json() for df in (nested, raw, *labelled)}) == 1


def test_folder_of_parts_empty_files_and_errors(spark, tmp_path):
    folder = tmp_path / "train.jsonl"
    folder.mkdir()
    for i, part in enumerate((ROWS[:20], [], ROWS[20:])):
        (folder / f"part-{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    (folder / "_SUCCESS").write_text("")
    assert [r[0] for r in rows(read_dataset(spark, "part_data", str(tmp_path), block_bytes=300), "query")] == [r["query"] for r in ROWS]
    for kind, split, error in (("no_kind", "train", "unknown dataset kind"), ("made_valid_data", "train", "has no 'train' split"),
                               ("full_data", "train", "dataset.tsv.gz")):
        with pytest.raises(Exception, match=error):
            read_dataset(spark, kind, str(tmp_path), split).collect()
    (tmp_path / "test.jsonl").write_text('{"query": "ok"}\n{"query": ')
    with pytest.raises(Exception):
        read_dataset(spark, "part_data", str(tmp_path), "test").collect()
    (tmp_path / "val.jsonl").write_text("")
    assert read_dataset(spark, "part_data", str(tmp_path), "validation").count() == 0

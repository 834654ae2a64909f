"""Score buckets over stored corpora against a plain percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankshift.operators import buckets as BK


@pytest.mark.parametrize("draw", [lambda r: r.random(), lambda r: r.randrange(3) * 1.0, lambda r: 7.0])
def test_buckets_equal_plain(spark, tmp_path, monkeypatch, draw):
    monkeypatch.setattr(BK, "SKETCH", 8)       # a poor sketch: bands miss and widen
    monkeypatch.setattr(BK, "MARGIN", 0.0001)
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "en", "de", None]), draw(rng) if i % 50 else None) for i in range(4000)]
    rows += [(9000, "one", 1.0), (9001, "two", 1.0), (9002, "two", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    folder = str(tmp_path / "store")
    for part in range(3):
        BK.add_corpus(df.where(F.col("doc_id") % 3 == part), folder, f"c{part}")
    BK.add_corpus(df.where(F.col("doc_id") % 3 == 1), folder, "c1")  # again: replaced, not doubled
    got = {r["doc_id"]: r["bucket"] for r in BK.bucketed(spark, folder).collect()}
    want = {}
    for lang in ("en", "de", "one", "two"):
        v = [(i, x) for i, g, x in rows if g == lang and x is not None]
        low, high = np.percentile([x for _, x in v], [100 / 3, 200 / 3])
        want |= {i: "head" if x <= low else "middle" if x <= high else "tail" for i, x in v}
    assert got == want


def test_new_corpus_leaves_stored_files(spark, tmp_path):
    folder = tmp_path / "store"
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.rand(1).alias("perplexity"))
    BK.add_corpus(df, str(folder), "a")
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("corpus=a/*")}
    BK.add_corpus(df, str(folder), "b")
    assert before and before == {p: p.stat().st_mtime_ns for p in folder.rglob("corpus=a/*")}
    assert BK.merged_sketches(spark, str(folder)).first()["n"] == 200

"""Invariants: partition-count independence, pack = token stream minus tail,
decode(encode(x)) = normalised x, stream = batch fold = plain fold."""

from pyspark.sql import functions as F

from conftest import SF001, SF01
from rankshift.operators import clean as C
from rankshift.operators import tokens as TK
from rankshift.plans import registry
from rankshift.sources.tables import table
from rankshift.streaming import settings as ST


def _docs(spark, sf=SF001):
    d = table(spark, sf, "documents")
    return C.with_tokens(d.select(F.col("doc_id").alias("ord"), "text"))


def test_pack_equals_stream_minus_tail(spark):
    d = _docs(spark)
    stream = [t for r in d.orderBy("ord").collect() for t in r["tokens"]]
    for parts in (1, 4, 16):
        p = TK.pack_corpus(d.repartition(parts), 32, "tokens", "ord", width=7)
        blocks = sorted((r["block"], r["input_ids"]) for r in p.collect())
        assert [b for b, _ in blocks] == list(range(len(stream) // 32))
        assert [t for _, ids in blocks for t in ids] == stream[: (len(stream) // 32) * 32]


def test_decode_encode(spark):
    d = _docs(spark)
    v = TK.build_vocab(d)
    back = TK.decode(TK.encode(d, v, "ord", "text"), v, "ord")
    want = {r["ord"]: " ".join(r["tokens"]) for r in d.collect()}
    assert {r["ord"]: r["text"] for r in back.collect()} == want


def test_vocab_ids_dense(spark):
    v = TK.build_vocab(_docs(spark))
    ids = sorted(r["id"] for r in v.collect())
    assert ids == list(range(len(ids)))


def test_bm25_partition_independent(spark):
    q = registry.QUERIES["bm25_scores"]
    base = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, q(spark, SF001).collect())) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _plain_fold(spark, sf):
    ev = table(spark, sf, "events").toPandas().sort_values(["user_id", "ts", "event_id"])
    rows = []
    for _, g in ev.groupby("user_id", sort=True):
        _, out, _ = ST.fold(ST.START, g)
        rows += out
    return sorted((r[0], r[1], r[5], r[6], r[7], r[8]) for r in rows)


def _rows(df):
    return sorted((r["user_id"], r["event_id"], r["outcome"], r["model"], r["word_count"], r["mode"])
                  for r in df.collect())


def test_fold_batch_equals_plain(spark):
    want = _plain_fold(spark, SF01)
    got = _rows(ST.settings_fold(table(spark, SF01, "events"), chunk_seconds=3600))
    assert got == want
    assert _rows(ST.settings_fold(table(spark, SF01, "events"), chunk_seconds=7 * 86400)) == want


def test_stream_equals_plain(spark):
    want = _plain_fold(spark, SF001)
    path = registry.run_settings_stream(spark, SF001)
    got = _rows(spark.read.schema(ST.OUT_SCHEMA).parquet(path))
    assert got == want


def test_funnel_counts_add_up(spark):
    d = _docs(spark, SF01).withColumn("lang", F.lit("en"))
    row = C.funnel(d, "common", {"word_patterns": C.LANG_WORD, "max_word_len": 15}).first().asDict()
    removed = sum(v for k, v in row.items() if k.startswith("removed_"))
    assert row["n_in"] == removed + row["n_out"]


def test_run_positions_equal_direct(spark):
    from rankshift.operators import generate as G
    from rankshift.plans import evaluation, runs, standins
    q, c = standins.queries(spark, SF01), standins.candidates(spark, SF01)
    g = G.variants(q, c, (5, 40), (False, True), "echo")
    inc = runs.run_positions(c, q, g)
    direct = evaluation.fake_positions_for(c, q, g, ["run", "qid"])
    cols = ["ranker", "run", "qid", "n", "loc", "n_rel", "n_rel_above"]
    assert sorted(map(tuple, inc.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))


def test_stream_state_across_microbatches(spark, tmp_path):
    import time as _time
    events = table(spark, SF001, "events")
    ts = events.select("ts").toPandas()["ts"].sort_values().tolist()
    cuts = [ts[300].to_pydatetime(), ts[700].to_pydatetime()]
    src = tmp_path / "events"
    parts = [F.col("ts") < F.lit(cuts[0]), (F.col("ts") >= F.lit(cuts[0])) & (F.col("ts") < F.lit(cuts[1])),
             F.col("ts") >= F.lit(cuts[1])]
    for k, cond in enumerate(parts):
        events.where(cond).coalesce(1).write.parquet(str(src / f"part{k}"))
        _time.sleep(1.1)  # the file source takes files in modification order
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = (ST.settings_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    got = _rows(spark.read.schema(ST.OUT_SCHEMA).parquet(out))
    assert got == _plain_fold(spark, SF001)


def test_prefix_offsets_of_sparse_order(spark):
    from rankshift.operators.order import RUN_BUCKETS, prefix_offsets

    ords = [i * i * 7919 - 40_000_000 for i in range(400)]  # buckets of one row, in runs of uneven length
    d = spark.createDataFrame([(o, o % 5) for o in reversed(ords)], "ord long, n long")
    for width in (1, 1000, 10_000 * RUN_BUCKETS):
        got = {r["ord"]: r["offset"] for r in prefix_offsets(d, "ord", "n", width=width).collect()}
        assert [got[o] for o in ords] == [sum(x % 5 for x in ords[:i]) for i in range(len(ords))]


def test_text_corpus_lines_are_numbered(spark, tmp_path):
    from rankshift.sources.readers import read_text_corpus

    spark.range(40).selectExpr("concat('line ', id) AS value").repartitionByRange(4, "value").sortWithinPartitions(
        "value").write.text(str(tmp_path / "t"))
    rows = read_text_corpus(spark, str(tmp_path / "t")).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in rows] == list(enumerate(sorted(f"line {i}" for i in range(40))))


def test_fold_is_the_state_machine_on_odd_events(spark):
    """Every order of events, ties in time, null and extreme values, against the event-by-event machine."""
    import datetime as dt
    import random
    rng = random.Random(4)
    kinds = ["signup", "purchase", "click", "view", "view", "error", "other", None]
    rows = [(i, rng.randrange(6), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(90)), rng.choice(kinds),
             rng.choice([None, 9.0, 10.0, 10.9, 500.0, 1023.9, 1024.0, -3.5, 0.0])) for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    want = []
    for user in range(6):
        state = ST.START
        for i, _, ts, kind, value in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            text = ST.event_text(kind, value)
            state, outcome = ST.step(state, kind, text)
            want.append((user, i, text, outcome, *state))
    for seconds in (3600, 10**9):
        got = ST.settings_fold(ev, seconds).select("user_id", "event_id", "text", "outcome", "model", "word_count", "mode")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ST.settings_fold(ev.limit(0)).count() == 0

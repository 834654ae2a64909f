"""Mixing sources to target weights.

1. Size of a document = number of words.  One aggregation gives each source
   its size and row count (partial aggregation, so a hot source is no hot task).
2. Targets: each source may take at most ``max_epochs`` times its size; the
   rest is shared by weight until no source is above its bound.  In closed
   form: order sources by bound / weight; the sources whose bound lies below
   the common level are full, the others get level x weight.
3. Every document gets a hash-random key.  Equal key ranges cut a source
   into buckets of about ``BUCKET_ROWS`` rows (keys are uniform, so the
   number of buckets follows the source's row count and no bucket is hot).
   Running sums inside each bucket, over the bucket totals of each run of
   ``RUN_BUCKETS`` buckets, and over the totals of the runs are the
   distributed prefix sum; the last one sorts one row for some two million
   documents of a source.
4. Budget of a source = floor(target): whole epochs of it, then documents in
   key order up to the exact rest; the document at the cut gives only its
   first words.  So ``taken`` adds up to the budget.

Defined results: null text has size 0 and takes 0; a null source is a source
of its own, last in order; repeated rows are mixed as separate rows (rows
equal in source and id share a key; ties go by size); an empty table gives
no rows.  A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankshift.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
BUCKET_ROWS = 2_000
RUN_BUCKETS = 1_000


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, rows) plus ``target``.  One row per source: the only global
    windows here run over that table, which is as long as the list of sources."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = (sources.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         # full while its bound is below its share of what the sources before it left
         .withColumn("full", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")))
    open_ = ~F.col("full")
    s = (s.withColumn("level_n", F.max(F.when(open_, F.col("left"))).over(everything))
         .withColumn("level_w", F.max(F.when(open_, F.col("w_left"))).over(everything)))
    return s.select("source", "source_size", "rows",
                    F.when(F.col("full"), F.col("cap").cast("double"))
                     .otherwise(F.col("level_n") * F.col("w") / F.col("level_w")).alias("target"))


def _sum_before(column: str, window: Window) -> Column:
    """Sum over the rows before this one, 0 for the first."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (see the module text)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
                    F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = materialize(d, "mix-sizes")  # ids and sizes only; the texts are read once
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = materialize(source_targets(sources, max_epochs), "mix-targets")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    n_buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    d = (d.withColumn("key", key).join(targets, d["source"].eqNullSafe(targets["source"]))
         .drop(targets["source"])
         .withColumn("bucket", F.floor(F.col("key") / F.ceil(F.lit(float(1 << KEY_BITS)) / n_buckets))))
    totals = (d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
              .withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS)))
    runs = totals.groupBy("source", "run").agg(F.sum("n").alias("n"))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"),
                       _sum_before("n", Window.partitionBy("source").orderBy("run")).alias("in_runs"))
    totals = totals.withColumn("in_run", _sum_before("n", Window.partitionBy("source", "run").orderBy("bucket")))
    starts = (totals.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
              .select("s", F.col("bucket").alias("b"), (F.col("in_runs") + F.col("in_run")).alias("base")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    d = d.withColumn("ahead", _sum_before("size", inside))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor("target").cast("long")
    size_or_one = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size_or_one).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("base") - F.col("ahead"), F.lit(0)), F.col("size"))
    return d.select("doc_id", "size", "source_size", "target",
                    (epochs * F.col("size") + last).cast("long").alias("taken"))


def op2(docs: DataFrame) -> DataFrame:
    return mix(docs)


#: The same in DuckDB SQL; ``{docs}`` is the table to mix.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()
        - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM n),
f AS (SELECT *, cap * w_left <= left_ * w AS full_ FROM o),
l AS (SELECT max(left_) AS ln, max(w_left) AS lw FROM f WHERE NOT full_),
t AS (SELECT f.source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE (ln * w)::DOUBLE / lw::DOUBLE END AS target FROM f, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
        floor(t.target)::BIGINT AS budget
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END * size
   + least(greatest(budget - CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END * source_size - ahead, 0), size))::BIGINT AS taken
FROM r
"""

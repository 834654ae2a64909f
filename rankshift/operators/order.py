"""Dense order without a global single-task window.

``prefix_offsets`` gives every row the sum of ``weight`` over all rows with
a smaller ``ord`` (exclusive prefix sum); with no weight this is the dense
0-based row index.  Work is split by ``bucket`` (default ``ord div width``):

1. per-bucket totals (partial aggregation; one row per bucket),
2. running sum over the buckets of each run of ``RUN_BUCKETS`` buckets, and
   over the totals of the runs (one row for a thousand buckets, so a sparse
   ``ord`` with a bucket a row still leaves little for the one global step),
3. equi-join back on the bucket,
4. offset inside a bucket by a window partitioned by the bucket.

Buckets derive from ``ord``, not from partition ids, so a retried stage
gives the same answer.  ``ord`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


RUN_BUCKETS = 1_000


def _before(col: str, window: WindowSpec) -> Column:
    """Sum over the rows before this one, 0 for the first."""
    return F.coalesce(F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def prefix_offsets(df: DataFrame, ord_col: str = "ord", weight: str | Column | None = None,
                   out: str = "offset", width: int = 100_000, bucket: Column | None = None,
                   run: Column | None = None) -> DataFrame:
    """``bucket`` must follow the order of ``ord_col``, and ``run`` that of ``bucket``."""
    w = F.lit(1).cast("long") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight).cast("long")
    if bucket is None:
        bucket, run = F.floor(F.col(ord_col) / width), F.floor(F.col(ord_col) / (width * RUN_BUCKETS))
    d = df.withColumns({"_w": w, "_run": bucket if run is None else run, "_bkt": bucket})
    totals = d.groupBy("_run", "_bkt").agg(F.sum("_w").alias("_bs"))
    runs = totals.groupBy("_run").agg(F.sum("_bs").alias("_rs"))
    runs = runs.select("_run", _before("_rs", Window.orderBy("_run")).alias("_ahead"))
    in_run = _before("_bs", Window.partitionBy("_run").orderBy("_bkt"))
    bases = (totals.select("_run", "_bkt", in_run.alias("_in_run")).join(runs, "_run")
             .select("_run", "_bkt", (F.col("_ahead") + F.col("_in_run")).alias("_base")))
    d = d.withColumn("_in", _before("_w", Window.partitionBy("_run", "_bkt").orderBy(ord_col)))
    return (d.join(bases, ["_run", "_bkt"]).withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
            .drop("_w", "_run", "_bkt", "_base", "_in"))


def dense_index(df: DataFrame, ord_col: str = "ord", out: str = "row_index", width: int = 100_000) -> DataFrame:
    return prefix_offsets(df, ord_col, None, out, width)


def file_order(df: DataFrame, out: str = "ord") -> DataFrame:
    """Dense 0-based row index (long) of a file source in file order.  Apply directly after ``spark.read``.

    Rows of one split (file path, block start) have consecutive ids in their
    task, so the index is the rows of all splits before it plus the distance
    from the split's smallest id.  The only global step runs over one row a
    split; the files are read once more for the counts, without columns."""
    d = (df.withColumn("_f", F.col("_metadata.file_path")).withColumn("_b", F.col("_metadata.file_block_start"))
         .withColumn("_i", F.monotonically_increasing_id()))
    splits = d.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_base"))
    return (d.join(base, ["_f", "_b"]).withColumn(out, (F.col("_i") + F.col("_base")).cast("long"))
            .drop("_f", "_b", "_i", "_base"))

"""Exact percentiles without holding a group in one task.

``percentile(v, p)`` buffers every value of a group in one task.  Here the
group is narrowed first with ``percentile_approx`` (bounded sketch, partial
aggregation), then only the distinct values of the narrow band around the
target rank are ordered exactly, each with its number of rows.  The values
inside the band hold about ``8 / accuracy`` of the group; the two at its ends
may be as frequent as they like, since ties are counted before the ordering.
Result equals ``percentile_cont`` (linear interpolation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentile(df: DataFrame, value: str, p: float, by: Sequence[str] = (),
                     alias: str = "percentile", accuracy: int = 100000) -> DataFrame:
    by = list(by)
    g = by if by else ["_g"]
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not by:
        v = v.withColumn("_g", F.lit(0))
    eps = 4.0 / accuracy
    lo_p, hi_p = max(0.0, p - eps), min(1.0, p + eps)
    approx = F.percentile_approx("_v", F.array(F.lit(lo_p), F.lit(hi_p)), accuracy)
    bounds = v.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"), approx.alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    bounds = bounds.select(
        *g, "_n",
        (F.col("_min") if lo_p == 0.0 else F.col("_b")[0]).alias("_lo"),
        (F.col("_max") if hi_p == 1.0 else F.col("_b")[1]).alias("_hi"))
    # one row per group: a proven bound only when there is a single group
    b_side = F.broadcast(bounds) if not by else bounds
    # equal values are one row with a count from here on: ties cannot fill the band
    j = v.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_k")).join(b_side, g)
    below = j.groupBy(*g).agg(F.sum(F.when(F.col("_v") < F.col("_lo"), F.col("_k")).otherwise(0)).alias("_below"))
    band = j.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    w = Window.partitionBy(*g).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    band = band.select(*g, "_v", "_n", "_k", F.sum("_k").over(w).alias("_upto"))
    h = (F.col("_n") - 1) * F.lit(p)
    ranked = (band.join(F.broadcast(below) if not by else below, g)
              .select(*g, "_v", (F.col("_below") + F.col("_upto") - F.col("_k")).alias("_from"),
                      (F.col("_below") + F.col("_upto")).alias("_to"), F.floor(h).alias("_i"),
                      (h - F.floor(h)).alias("_f")))

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    res = ranked.groupBy(*g).agg(at(F.col("_i")).alias("_a"), at(F.col("_i") + 1).alias("_c"),
                                 F.first("_f").alias("_f"))
    out = F.when(F.col("_c").isNull(), F.col("_a")).otherwise(
        F.col("_a") + F.col("_f") * (F.col("_c") - F.col("_a")))
    return res.select(*by, out.alias(alias))

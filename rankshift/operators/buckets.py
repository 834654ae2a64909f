"""Head / middle / tail buckets by score (CLN7), kept over many corpora.

A store folder holds, for each corpus, its narrow score table and one quantile
sketch (KLL) a group.  A new corpus adds its own two tables; nothing of the
others is read again but their scores: sketches of all corpora merge into the
band that must hold a cut, and only counts below the band and the distinct
values inside it are taken from the scores.

Cuts are exact (linear interpolation between neighbours): the sketch gives a
band, exact counts tell whether the wanted ranks lie in it, and a band that
misses one is widened until it holds all.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankshift.session import materialize

NAMES = ("head", "middle", "tail")
SKETCH = 4096   # sketch size: about 0.1 % rank error
MARGIN = 0.002  # share of a group on each side of a cut in the first band


def add_corpus(scores: DataFrame, folder: str, corpus: str, value: str = "perplexity",
               by: Sequence[str] = ("lang",)) -> None:
    """Store one corpus: its rows (any columns; null groups and null scores are kept but have no bucket) and one
    sketch a group.  Storing a corpus again replaces it and leaves the others alone."""
    by = list(by)
    path = os.path.join(folder, "scores", f"corpus={corpus}")
    scores.write.mode("overwrite").parquet(path)
    rows = scores.sparkSession.read.parquet(path).where(F.col(value).isNotNull())
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    v = F.col(value).cast("double")
    (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                           F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("sketch"))
     .write.mode("overwrite").parquet(os.path.join(folder, "sketches", f"corpus={corpus}")))


def merged_sketches(spark: SparkSession, folder: str, by: Sequence[str] = ("lang",)) -> DataFrame:
    """(by, n, least, most, sketch) over all stored corpora: one row a group, from one row a corpus and group."""
    s = spark.read.parquet(os.path.join(folder, "sketches"))
    return s.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"),
                              F.kll_merge_agg_double("sketch").alias("sketch"))


def cut_values(spark: SparkSession, folder: str, shares: Sequence[float] = (1 / 3, 2 / 3), value: str = "perplexity",
               by: Sequence[str] = ("lang",)) -> DataFrame:
    """(by, cuts): the exact values at ``shares`` of each group over all stored corpora."""
    by = list(by)
    groups = materialize(merged_sketches(spark, folder, by), "merged_sketches")
    rows = spark.read.parquet(os.path.join(folder, "scores")).select(*by, F.col(value).cast("double").alias("v"))
    margin, done, left = MARGIN, None, None

    def around(i: int, p: float):
        """One cut's band and wanted rank; the shares are constants, as the sketch functions ask."""
        rank = (F.col("n") - 1) * F.lit(p)
        lo, hi = (F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q)))) for q in (p - margin, p + margin))
        return F.struct(F.lit(i).alias("i"), F.floor(rank).alias("at"), (rank - F.floor(rank)).alias("part"),
                        (F.col("least") if p - margin <= 0 else lo).alias("lo"),
                        (F.col("most") if p + margin >= 1 else hi).alias("hi"))

    while True:
        band = groups.select(*by, F.inline(F.array(*(around(i, p) for i, p in enumerate(shares)))))
        band = band if left is None else band.join(left, [*by, "i"], "left_semi")
        band = materialize(band, "score_bands")  # one row a group and cut
        # rows below a band are counted, those inside are grouped by value before anything is ordered
        near = rows.join(band, by).where(F.col("v") <= F.col("hi"))
        inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
        cells = (near.groupBy(*by, "i", "at", "part", inside.alias("v")).agg(F.count(F.lit(1)).alias("k")))
        upto = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first())  # null: all below the band, first
        cells = cells.withColumn("to", F.sum("k").over(upto.rowsBetween(Window.unboundedPreceding, 0)))

        def at(r):
            return F.max(F.when((F.col("to") - F.col("k") <= r) & (r < F.col("to")), F.col("v")))

        got = cells.groupBy(*by, "i").agg(at(F.col("at")).alias("a"), at(F.col("at") + 1).alias("b"),
                                          F.first("part").alias("part"))
        got = got.withColumn("cut", F.when(F.col("part") == 0, F.col("a")).otherwise(
            F.col("a") + F.col("part") * (F.col("b") - F.col("a"))))
        found = materialize(got.select(*by, "i", "cut").where(F.col("cut").isNotNull()), "score_cuts")
        done = found if done is None else done.unionByName(found)
        left = band.join(found.select(*by, "i"), [*by, "i"], "left_anti").select(*by, "i")
        if margin >= 1 or left.isEmpty():
            break
        margin *= 8
    return done.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "cut"))).alias("c")).select(
        *by, F.col("c.cut").alias("cuts"))


def bucketed(spark: SparkSession, folder: str, shares: Sequence[float] = (1 / 3, 2 / 3), value: str = "perplexity",
             by: Sequence[str] = ("lang",), names: Sequence[str] = NAMES) -> DataFrame:
    """The stored rows of all corpora that have a group and a score, with ``corpus`` and ``bucket``: the first name
    up to and including the first cut, and so on."""
    by = list(by)
    cuts = cut_values(spark, folder, shares, value, by)
    rows = spark.read.parquet(os.path.join(folder, "scores")).where(F.col(value).isNotNull()).join(cuts, by)
    place = F.size(F.filter("cuts", lambda c: F.col(value) > c))
    return rows.withColumn("bucket", F.element_at(F.array(*map(F.lit, names)), place + 1)).drop("cuts")

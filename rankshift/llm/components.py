"""Connected components of an edge table by alternating star contraction.

Each round links every node to the smallest node of its neighbourhood (large
star: larger neighbours only; small star: smaller ones), which halves the
depth of the trees; the loop ends when a round changes nothing.  A round is
two aggregations and two joins on the node; the minimum of a hot node is
pre-aggregated in each task and its join is left to skew handling.  Rounds
are written to the shared checkpoint folder, so a lost executor never
replays earlier rounds.  Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  ``edges``: distinct (u, v) with v < u."""
    if large:  # neighbours of u in both directions, smallest neighbour or itself; move the larger neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours of u and u itself go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v) that is not its own root."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialize(e, "components-edges")
    before = None
    for _ in range(max_rounds):
        e = materialize(_stars(_stars(e, True), False), "components-round")
        # the sums fix the state: parents only ever get smaller
        state = e.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if before == tuple(state) and state[0] == state[2]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError("components: no fixpoint")

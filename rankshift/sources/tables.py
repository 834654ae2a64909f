"""Access to the Parquet tables of one scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Bytes of a file that may be one row group, and so one task, yet enough work for all cores.
ONE_GROUP = (1 << 20, 64 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` of a file source with its rows dealt to all cores if the files are small enough to be one row group,
    which Spark cannot split.  Larger inputs have row groups enough and stay as they are; rows do not change."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if ONE_GROUP[0] <= size <= ONE_GROUP[1]:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df

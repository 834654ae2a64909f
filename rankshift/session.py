"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str = "local[8]", app: str = "rankshift",
                  shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session (``SparkSession.getActiveSession()``) and size
    ``spark.sql.shuffle.partitions`` to the data instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # post-shuffle build sides under this size become shuffled hash joins (no sort)
         .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
         .config("spark.driver.memory", "16g"))
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; only when it is unset (local tests)
    is a fresh folder created here.  On any other master an unset folder is
    an error: a driver-local folder would not be seen by the executors."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="rankshift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts lineage (a lost executor does not replay the upstream work)
    and lets several consumers share one computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def written(df, name: str, rows: int | None = None):
    """``materialize`` for tables with packed columns: strongly compressed, and shuffle files of the job go as soon as
    it ends.  ``rows``: rows of a table that a Python task takes at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def cluster_conf(total_input_bytes: int, executors: int, cores_per_executor: int) -> dict:
    """Settings to pass to the cluster's session for a given input size.

    Shuffle partitions: about one 256 MB partition per core-wave, at least 2x
    the cores; AQE coalesces what turns out smaller and splits skewed
    partitions (a key holding a third of the rows is split, not run whole).
    Broadcasts are left to AQE's runtime statistics with a modest threshold;
    operators that broadcast on their own check the size first."""
    cores = max(1, executors * cores_per_executor)
    parts = max(2 * cores, total_input_bytes // (256 << 20))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(256 << 20),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }

"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "quillspark") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE is on so that shuffle partitions coalesce at runtime and skewed join
    partitions are split; the UI is off (no server is started).
    """
    # Master and shuffle partitions are the caller's or spark-submit's; on a
    # cluster the latter are (shuffled bytes / 128-256 MB) as the initial number,
    # AQE coalesces small ones and splits skewed ones at runtime.
    master = master or os.environ.get("QS_MASTER")
    parts = shuffle_partitions or os.environ.get("QS_SHUFFLE_PARTITIONS")
    max_part_bytes = os.environ.get("QS_FILES_MAX_PARTITION_BYTES", "128m")
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", max_part_bytes)
        # joins on (file, line) reuse the per-file hash partitioning of the lines table
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset and the master is local (tests) a scratch folder
    is created; elsewhere executors couldn't see one, and it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="qs-ckpt-", dir="/tmp")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables of ``sf_dir`` as temp views (lazy scans)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)

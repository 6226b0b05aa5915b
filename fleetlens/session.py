"""Session helpers.

Library functions never create a session; they take DataFrames. These helpers
are for tests, ``bench.py`` and interactive use on a single machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Context managers, called with the session, that the job runner enters around each query it writes.
AROUND_JOB: list = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fleetlens") -> SparkSession:
    """A local session configured like the cluster jobs expect.

    Adaptive execution stays on so that joins whose measured side is small
    become broadcast joins at run time, skewed partitions are split and tiny
    shuffle partitions are coalesced.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local session without it (tests, a laptop) gets a private scratch
    folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


# Settings for a large cluster (many executors, tens to hundreds of TB). The
# library never sets these itself; a job launcher passes them at submit time.
# Partition counts follow the data, not the cores: shuffles start with many
# partitions and adaptive execution coalesces them to the advisory size, so
# a 100 TB input read in 256 MB splits (about 400,000 tasks) aggregates into
# partitions that fit executor memory and spill rarely.
CLUSTER_SETTINGS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "100000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # split a partition that is 4x the median and above 512 MB (hot clusters)
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    # broadcast only sides measured below this at run time
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # lost executors: move shuffle and cached blocks off decommissioned
    # nodes, and retry tasks and stages rather than failing the job
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
    # reliable checkpoints are removed once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # streaming state (one entry per cluster) kept off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

"""Session construction and the shared scratch folder.

Library code never creates a session on its own; these helpers are for
``bench.py``, tests and command-line use. On a cluster the session comes from
the environment and ``spark.checkpoint.dir`` names the shared folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "loanroll") -> SparkSession:
    """Local/test session with AQE on and the UI off."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOANROLL_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a private one only when it is unset.

    A cluster names a shared folder there. Only a local session falls back to
    a fresh folder of its own: on several nodes each would write its own disk.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="loanroll-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/loanroll/{name}-{uuid.uuid4().hex[:12]}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_conf(shuffle_bytes: float, cores: int, target_partition_bytes: float = 256 * 1024 ** 2) -> dict[str, str]:
    """Sizing for a cluster run (apply at session build or with ``spark.conf.set``).

    ``shuffle_bytes`` is the largest stage's shuffle volume (for the reports:
    the ledger's partial aggregates, roughly its size in the columns read).
    Partitions are sized to ~``target_partition_bytes`` so a task fits in
    executor memory without spilling, and never fewer than 2 per core; AQE
    coalesces small ones and splits skewed join partitions at runtime.
    """
    partitions = max(2 * cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(int(target_partition_bytes * 4)),
    }

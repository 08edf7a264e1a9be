"""Session construction and the shared scratch location.

Cluster jobs must not write to a machine-local temp folder: anything that
cuts lineage (``checkpoint()``) or stages intermediate tables goes under the
folder named by ``spark.checkpoint.dir``.  The setting is read from the
session; only when it is unset (tests, local runs) do we pick one ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold for every scale.  Shuffle partitions are sized for the
# local test machine; on a cluster pass ``shuffle_partitions`` (AQE then
# coalesces small partitions and splits skewed ones at runtime).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast is decided by Spark from plan statistics (and by AQE from
    # measured shuffle sizes): a side is broadcast only below this size,
    # otherwise the join falls back to a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Pages and range blocks are checkpointed to the shared folder; remove
    # those files once their DataFrames are garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "wayline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def local_scratch(master: str) -> str:
    """A new temporary folder, for ``local`` masters only (local runs and tests)."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to storage that all executors share")
    return tempfile.mkdtemp(prefix="wayline-ckpt-")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; where it is unset, set a local one in local mode only.

    On a cluster an unset folder is an error: a folder of the driver's machine
    is not seen by the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        current = local_scratch(spark.sparkContext.master)
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - some sessions refuse core confs at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for staged tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")

"""Session helpers: a local session for tests/bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spanfold") -> SparkSession:
    """Local session used by tests and bench.py; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SPANFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``. Only a session with a ``local`` master may leave it
    unset (tests): then a folder under /tmp is created. Anywhere else that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (remote session: the server owns the checkpoint dir)
        sc = None
    base = spark.conf.get("spark.checkpoint.dir", None)
    if sc is not None:
        base = base or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="spanfold-ckpt-", dir="/tmp")
            sc.setCheckpointDir(base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the scratch folder (never reused, never deleted here)."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back. It is computed once, where
    ``checkpoint`` computes it a second time to store it, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

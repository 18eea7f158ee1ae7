"""Session helpers.

Library code never creates a session on its own; these helpers exist for
tests, the bench and command-line use. On a cluster the caller's session is
used as is, and `checkpoint_dir` only reads what the cluster configured.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bytelane") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BYTELANE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only when unset.

    On a cluster `spark.checkpoint.dir` names a shared folder and is used as
    is. Only a session without it (a local test) gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="bytelane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table below the checkpoint folder, so that later steps don't compute it again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"bytelane-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, remembered for `remove_scratch`."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    _SCRATCH.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables and folders that this driver's operators have written below the checkpoint folder; returns their number.

    Results are read from such tables, so call it when they have been used.
    Files go through Hadoop's file system, wherever the folder is.
    """
    jvm, conf, removed = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors if their Python would not find it.

    Python workers see the folder that the driver was started in and
    `PYTHONPATH`; from elsewhere, uninstalled, the package goes as a zip file.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root in found or "site-packages" in root or spark.conf.get("spark.bytelane.shipped", None):
        return
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="bytelane-zip-"), "bytelane"), "zip", root, "bytelane"))
    spark.conf.set("spark.bytelane.shipped", "true")

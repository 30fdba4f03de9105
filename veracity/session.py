"""Session construction and cluster-wide settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "veracity",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults.

    On a cluster the session already exists (spark-submit); nothing is
    overridden there.  Locally (tests, bench) AQE, Arrow and UTC are pinned
    and the UI is kept off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("VERACITY_MASTER") or "local[8]"
    parts = shuffle_partitions or int(os.environ.get("VERACITY_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERACITY_DRIVER_MEMORY", "16g"))
    )
    if os.environ.get("VERACITY_CHECKPOINT_DIR"):
        spark = spark.config("spark.checkpoint.dir", os.environ["VERACITY_CHECKPOINT_DIR"])
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only when it is
    unset (local tests) a fresh scratch folder is created and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Unset (a local session built elsewhere for tests): a private scratch folder.
    local = tempfile.mkdtemp(prefix="veracity-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder, remembered for ``release_scratch``."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process wrote (row-index copies, round trips).

    Call it when the DataFrames built on them are no longer needed; uses the
    Hadoop FileSystem of each path, so it works on shared storage too.
    """
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    n = 0
    while _SCRATCH:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            n += 1
    return n

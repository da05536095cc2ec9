"""Spark session defaults for the monitor-trial jobs.

Everything runs with a UTC session clock (the device and tablet clocks are
wall-clock readings without zone), adaptive query execution on, and Arrow
batches for the few pandas steps.  On a cluster the session is created by the
platform; :func:`configure` fills settings that are still unset, and sets the
session clock to UTC in any case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings applied when the session does not define them already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    # Wall-clock readings are compared as they are: the jobs need a UTC clock.
    conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tocsin") -> SparkSession:
    """Session for tests and the local bench: local mode, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TOCSIN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage; only a local
    (test) session gets a scratch folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tocsin-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


# What jobs have left behind for later reads: folders under the checkpoint
# folder, and persisted tables.  Their owner is the session, until release().
_FOLDERS: list[str] = []
_KEPT: list = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, freed with :func:`release`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tocsin-{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back.  Cuts the lineage (a lost executor does not recompute upstream
    shuffles) and lets later passes read only the columns they need.  The folder
    stays until :func:`release`."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def keep(df):
    """``df`` persisted (memory, then disk) until :func:`release`."""
    from pyspark import StorageLevel

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release(spark: SparkSession, folders_from: int = 0, kept_from: int = 0) -> int:
    """Delete the folders written and free the tables kept by the jobs of this
    session so far; returns how many.  Call it when their results are no longer
    read."""
    freed = 0
    while len(_KEPT) > kept_from:
        _KEPT.pop().unpersist()
        freed += 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_FOLDERS) > folders_from:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)
        freed += 1
    return freed


@contextmanager
def scratch(spark: SparkSession):
    """Releases on leaving what was written and kept inside; results that are
    still to be read must have been written elsewhere."""
    folders, kept = len(_FOLDERS), len(_KEPT)
    try:
        yield
    finally:
        release(spark, folders, kept)

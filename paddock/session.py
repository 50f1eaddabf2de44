"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings every job in the library assumes: UTC so DATE/TIMESTAMP
# arithmetic is day-exact, AQE for runtime re-planning (skew splits, partition
# coalescing, broadcast conversion from measured sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Only used when the session names no shared folder (local runs and tests).
LOCAL_SHARED_DIR = "/tmp/paddock-shared"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "paddock") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PADDOCK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only where it is unset (local tests) do we set our
    own. Materialised tables and ``checkpoint()`` data both live below it, so an
    executor loss never loses a cut lineage.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = LOCAL_SHARED_DIR
        os.makedirs(conf_dir, exist_ok=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf_dir.rstrip("/") + "/rdd-checkpoints")
    return conf_dir.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of this run, below the shared folder."""
    return f"{shared_dir(spark)}/paddock-work/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def with_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """These settings of the session inside, its own ones again afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """df written once as Parquet and read again: later jobs start from the files, also after losing an executor.

    The shuffled files of the write go as it ends, not whenever the driver collects its garbage: disks hold those of one job.
    """
    with with_conf(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, path: str) -> None:
    """Drops an intermediate table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the session's filesystem (local, HDFS, an object store) has the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def children(spark: SparkSession, path: str) -> list[str]:
    """The names below a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="terrapoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives the loss of executors.

    The files go when the Python process ends, or by forget().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes path when the Python process ends."""
    _written.append((spark, path))


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Deletes the table that written() made of df, once nothing reads it any more."""
    files = df.inputFiles()[:1]
    for item in [x for x in _written if any(x[1].rpartition("/")[2] in f for f in files)]:
        _delete(item)
        _written.remove(item)


def _delete(item: tuple[SparkSession, str]) -> None:
    spark, path = item
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for item in _written:
        try:
            _delete(item)
        except Exception:  # the session has ended before; its folder is the cluster's to clear
            return

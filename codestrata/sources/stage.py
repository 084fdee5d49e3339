"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process (local, as in tests) may do without: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/codestrata/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Shuffles of a query are removed as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """df, written once and read back. Phases whose result is used several times would otherwise be planned and run each time. Its shuffles go as soon as it is written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def settle(make: Callable[[], DataFrame], tag: str = "stage", instead: DataFrame | None = None) -> DataFrame:
    """make(), staged. What it staged on its way is removed, and so is `instead`, a staged frame: their rows must not be read again."""
    before = len(_written)
    out = stage(make(), tag)
    gone = [path for _, path in _written[before:-1]]
    if instead is not None:
        gone.append(_path_of[instead])
    for path in gone:
        remove_path(out.sparkSession, path)
    _written[:] = [w for w in _written if w[1] not in gone]
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where fewer partitions than there are have rows, as with one small file or few row groups; else as it is.

    Files are split by bytes, but a row group is read by one task. Which partitions have rows is only counted where there are fewer files than cores."""
    held = parts = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if parts >= cores and 0 < len(df.inputFiles()) < cores:
        held = df.select(F.spark_partition_id()).distinct().count()
    return df if held >= cores else df.repartition(max(cores, parts), key)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            remove_path(spark, path)

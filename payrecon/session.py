"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. A hot join key is split by AQE at run time;
# "force" keeps that split even when a later join has to shuffle again.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a file takes on disk says little of its rows in the driver's memory: constant columns take nothing there. So joins
    # are made broadcast joins at run time only, by the bytes that the rows were seen to take.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    # Runs of partitions are read together up to the second figure (compressed); with enough of them to begin with, a
    # task's sorts do not grow with the tables.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # The view has 126 columns; the default of 100 would take its last stages out of generated code.
    "spark.sql.codegen.maxFields": "200",
    # Methods above this size are never compiled by the JVM; Spark then takes its split-method path instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings of the plans on a session (SQL settings, no restart needed)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Only a session on one machine (a test) may do without ``spark.checkpoint.dir`` and gets a local folder; elsewhere
    executors would write to disks that the others cannot see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/payrecon-{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`work_dir`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def length(spark: SparkSession, path: str) -> int:
    """Bytes of the files that a path or a pattern of paths stands for; 0 if there are none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [target] if fs.exists(target) else [status.getPath() for status in fs.globStatus(target) or ()]
    return sum(fs.getContentSummary(p).getLength() for p in found)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it, so that it is there whole or not at all. An existing one is an error."""
    jvm = spark._jvm
    target, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(parts, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(parts, target):
        fs.delete(parts, False)
        raise FileExistsError(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING, _CLEANED = threading.Lock(), {"runs": 0, "before": "false"}


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes begun in here delete their shuffle files when they end, instead of whenever the driver's garbage happens to be collected.

    What is written is read back from files, so nothing comes back to those shuffles. Only for writes: a frame that is computed twice
    by the same plan would have to make its shuffles anew. May be nested and used by several threads of a session.
    """
    with _CLEANING:
        if not _CLEANED["runs"]:
            _CLEANED["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _CLEANED["runs"] += 1
    try:
        yield
    finally:
        with _CLEANING:
            _CLEANED["runs"] -= 1
            if not _CLEANED["runs"]:
                spark.conf.set(_CLEANUP, _CLEANED["before"])


_STAGES: list[tuple[SparkSession, str]] = []


def _remove_stages() -> None:
    for spark, path in _STAGES:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove_dir(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, where several parts of a plan read the same rows.

    The folder is removed when the driver's Python ends, as the returned frame reads it until then; the shuffle files go at once.
    """
    spark = df.sparkSession
    if not _STAGES:
        atexit.register(_remove_stages)
    path = work_dir(spark, name)
    _STAGES.append((spark, path))
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

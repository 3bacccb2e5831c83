"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"
#: Paths written inside each open ``temporary`` of a thread, the innermost last.
_OPEN = threading.local()


def build_session(master: str | None = None, name: str = "proofline", **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session that names none (a local test run) gets a folder on this machine; a session
    on a cluster without the setting is refused, because executors could not read it back.
    """
    named = spark.conf.get(SCRATCH_KEY, None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"set {SCRATCH_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(SCRATCH_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the files,
    so a lost executor re-reads them instead of recomputing what led here."""
    path = scratch_path(df.sparkSession, purpose)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if getattr(_OPEN, "paths", None):
        _OPEN.paths[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``materialize`` writes inside are removed at the end, except what the given
    function writes. Nothing else made inside can be read after it."""
    paths: list[str] = []
    _OPEN.paths = [*getattr(_OPEN, "paths", []), paths]

    def keep(df: DataFrame, purpose: str) -> DataFrame:
        table = materialize(df, purpose)
        path = paths.pop()
        if len(_OPEN.paths) > 1:
            _OPEN.paths[-2].append(path)
        return table

    try:
        yield keep
    finally:
        _OPEN.paths = _OPEN.paths[:-1]
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files of steps that are over go. Spark drops them when the driver's garbage is collected,
    which on a driver with much memory can be after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(rows: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt over all of them.

    Parsing text is bound by the processor, and one file can arrive as one split. A large table
    has splits enough and is left where it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

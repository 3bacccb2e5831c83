"""A recording of model calls as a log of runs: appended to, merged now and then, the last call of a key wins.

  <path>/calls/write=<id>       one run: kind, key, request, response, each (kind, key) once, in key order
  <path>/log/sequence=<n>       one row: the run's name, and whether it holds all that came before

An append reduces its own calls and moves nothing that is stored. A reader takes the newest whole
run and the runs behind it, so what it merges is bounded by what came since the last ``compact``.
Runs are cut by ranges of keys, so the files of a lookup are picked by their footers. A run is
part of the recording once its log row exists; of two writers of one number the later is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "kind STRING, key STRING, request STRING, response STRING"
LOG = "write STRING, whole BOOLEAN, sequence INT"


def _log(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(sequence, write, whole) of the runs a reader takes: one row for each append since a merge."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    first = log.where("whole").agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    return sorted((r["sequence"], r["write"], r["whole"]) for r in log.where(F.col("sequence") >= first).collect())


def _put(calls: DataFrame, path: str, sequence: int, whole: bool) -> int:
    write = f"w{uuid.uuid4().hex}"
    ordered = calls.select("kind", "key", "request", "response").repartitionByRange("kind", "key")
    ordered.sortWithinPartitions("kind", "key").write.parquet(f"{path}/calls/write={write}")
    row = calls.sparkSession.createDataFrame([(write, whole)], "write STRING, whole BOOLEAN")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/log/sequence={sequence}")
    return sequence


def _last(calls: DataFrame, *order: str) -> DataFrame:
    newest = F.max_by(F.struct("request", "response"), F.struct(*order)).alias("_c")
    return calls.groupBy("kind", "key").agg(newest).select("kind", "key", "_c.request", "_c.response")


def append_calls(calls: DataFrame, path: str) -> int:
    """Add calls (kind, key, request, response, position); of one key the greatest ``position`` is
    kept. Calls without a key are refused by the reader and not expected here. Returns the run's number."""
    log = _log(calls.sparkSession, path)
    return _put(_last(calls, "position"), path, (log[-1][0] if log else 0) + 1, False)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, request, response): the last call of every key."""
    log = _log(spark, path)
    if not log:
        return spark.createDataFrame([], CALLS)
    runs = None
    for sequence, write, _ in log:
        run = spark.read.schema(CALLS).parquet(f"{path}/calls/write={write}").withColumn("_run", F.lit(sequence))
        runs = run if runs is None else runs.unionByName(run)
    return runs.drop("_run") if len(log) == 1 else _last(runs, "_run")


def compact(spark: SparkSession, path: str) -> int:
    """Merge all runs into one. Readers that began before keep the runs they know."""
    log = _log(spark, path)
    if not log or len(log) == 1 and log[0][2]:
        return log[-1][0] if log else 0
    return _put(read_calls(spark, path), path, log[-1][0] + 1, True)

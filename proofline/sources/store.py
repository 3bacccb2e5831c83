"""Index tables in hash buckets, replaced by filing, read at a version.

  <path>/chunks/write=<id>/bucket=<b>    passages
  <path>/blocks/write=<id>/bucket=<b>    their vectors in blocks, as searches read them
  <path>/filings/write=<id>/bucket=<b>   one row per filing, with the digest of its passages
  <path>/log/version=<v>                 one row per bucket that version v wrote: bucket, write, buckets

A write makes new files for the buckets of its filings only, under a name of its own, and is part of
the index once its log rows exist; these are written last. A version of the index is, for every
bucket, the newest write up to that version. Older writes stay where they are, so a reader keeps
the version it began with. What a write leaves behind when it is cut off is never read.

Files number buckets times the blocks of the largest filing of each, whatever the number of filings.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import index as IX
from proofline.operators import retrieval as R

BUCKETS = 256
BLOCK_ROWS = 100_000
LOG = "bucket INT, write STRING, buckets INT, version INT"


def bucket_of(accession: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(accession), F.lit(buckets)).cast("int")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, write, buckets, version) of every write; no rows where there is no index yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _state(spark: SparkSession, path: str, version: int | None) -> tuple[int, int, dict[int, str]]:
    """(version, buckets, write of each bucket). The log has at most one row per bucket and version
    and is reduced to one per bucket before it is fetched."""
    log = read_log(spark, path)
    if version is not None:
        log = log.where(F.col("version") <= version)
    newest = log.groupBy("bucket").agg(F.max(F.struct("version", "write", "buckets")).alias("l")).select("bucket", "l.*").collect()
    last = max((row["version"] for row in newest), default=0)
    if version is not None and last != version:
        raise ValueError(f"{path} has no version {version}")
    return last, newest[0]["buckets"] if newest else 0, {row["bucket"]: row["write"] for row in newest}


def _read(spark: SparkSession, path: str, table: str, writes: dict[int, str]) -> DataFrame:
    folders = [f"{path}/{table}/write={write}/bucket={bucket}" for bucket, write in sorted(writes.items())]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*folders).drop("write")


def _table(
    spark: SparkSession, path: str, table: str, version: int | None, asked: DataFrame | None, exact: bool = True
) -> DataFrame:
    """``asked`` names the buckets that are read; with ``exact``, other filings of them are left out."""
    _, buckets, writes = _state(spark, path, version)
    if not writes:
        raise ValueError(f"{path} holds no index")
    rows = _read(spark, path, table, writes)
    if asked is not None:
        wanted = asked.select("accession", bucket_of(F.col("accession"), buckets).alias("bucket")).distinct()
        # At most ``buckets`` numbers: the folders that are read.
        some = {row["bucket"] for row in wanted.select("bucket").distinct().collect()}
        rows = _read(spark, path, table, {b: w for b, w in writes.items() if b in some} or writes)
        if exact:
            rows = rows.join(wanted, ["bucket", "accession"], "left_semi")
    return rows.drop("bucket")


def read_chunks(spark: SparkSession, path: str, version: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Passages at a version (the newest if none is named); of the filings of ``asked`` (accession)
    only, whose buckets are the only ones read."""
    return _table(spark, path, "chunks", version, asked).where(F.col("chunk_id").isNotNull())


def read_filings(spark: SparkSession, path: str, version: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Filings at a version with the number, size and digest of their passages."""
    return _table(spark, path, "filings", version, asked).where(F.col("accession").isNotNull())


def read_blocks(spark: SparkSession, path: str, version: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Blocks of vectors (accession, block, ids, orders, vectors) at a version."""
    return _table(spark, path, "blocks", version, asked, exact=False).where(F.col("accession").isNotNull())


def newest_version(spark: SparkSession, path: str) -> int:
    """0 where there is no index."""
    return _state(spark, path, None)[0]


def write_filings(chunks: DataFrame, filings: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Put filings into the index and return the version that has them.

    ``filings``: one row per accession, never null. ``chunks``: their passages (accession, chunk_id,
    ordinal, vector and more); passages of other accessions are not written. All that the index held
    of these filings is replaced; a filing without passages is taken out. The number of buckets is
    that of the first write. Of two writers of one version the later one is refused at its log.
    """
    spark = chunks.sparkSession
    last, known, writes = _state(spark, path, None)
    buckets = known or buckets
    write = f"w{uuid.uuid4().hex}"
    placed = filings.withColumn("bucket", bucket_of(F.col("accession"), buckets))
    # At most ``buckets`` numbers.
    touched = sorted(row["bucket"] for row in placed.select("bucket").distinct().collect())
    if not touched:
        return last
    own = chunks.join(filings.select("accession"), "accession", "left_semi").select(
        *chunks.columns, bucket_of(F.col("accession"), buckets).alias("bucket")
    )
    before = {b: writes[b] for b in touched if b in writes}
    gone = filings.select("accession")
    if before:
        stayed = _read(spark, path, "chunks", before).join(gone, "accession", "left_anti")
        own = own.unionByName(stayed)
    # A bucket that has lost its last passage is still a folder: an empty row stands for it.
    marks = spark.createDataFrame([(b,) for b in touched], "bucket INT")
    block = F.floor(F.coalesce("ordinal", F.lit(0)) / BLOCK_ROWS)
    whole = own.unionByName(marks, allowMissingColumns=True)
    whole.repartition("bucket", block).write.partitionBy("bucket").parquet(f"{path}/chunks/write={write}")
    written = _read(spark, path, "chunks", {b: write for b in touched}).where(F.col("chunk_id").isNotNull())
    blocks = R.passage_blocks(written).withColumn("bucket", bucket_of(F.col("accession"), buckets))
    blocks = blocks.unionByName(marks, allowMissingColumns=True)
    file = F.floor(F.coalesce("block", F.lit(0)) * R.BLOCK_ROWS / BLOCK_ROWS)
    blocks.repartition("bucket", file).write.partitionBy("bucket").parquet(f"{path}/blocks/write={write}")
    # Digests describe what was written, so nothing is embedded a second time for them.
    described = placed.join(IX.filing_digests(written.join(gone, "accession", "left_semi")), "accession")
    if before:
        described = described.unionByName(_read(spark, path, "filings", before).join(gone, "accession", "left_anti"))
    described = described.where(F.col("accession").isNotNull()).unionByName(marks, allowMissingColumns=True)
    described.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/filings/write={write}")
    entries = marks.select("bucket", F.lit(write).alias("write"), F.lit(buckets).alias("buckets"))
    entries.coalesce(1).write.mode("errorifexists").parquet(f"{path}/log/version={last + 1}")
    return last + 1

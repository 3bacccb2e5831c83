"""The passage index: audits, digests and conflicts, all as tables of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import vectors as V


def chunk_digest(accession: Column, chunk_id: Column, ordinal: Column, vector: Column) -> Column:
    """SHA-256 of one passage's place, id and vector."""
    return F.sha2(
        F.to_json(F.struct(accession.alias("accession"), ordinal.alias("ordinal"), chunk_id.alias("chunk_id"), vector.alias("vector"))),
        256,
    )


def filing_digests(chunks: DataFrame) -> DataFrame:
    """(accession, chunks, dimensions, digest): a digest of each filing's content.

    Passage digests carry their ordinal, so they can be added up in any order: a filing with a
    third of all passages is summed in parallel instead of being listed in one task. The sums are
    of 28-bit pieces, so they cannot overflow, and their SHA-256 is the digest.
    """
    hashed = chunks.select(
        "accession",
        F.size("vector").alias("_size"),
        chunk_digest(F.col("accession"), F.col("chunk_id"), F.col("ordinal"), F.col("vector")).alias("_h"),
    )
    pieces = [
        F.conv(F.substr(F.col("_h"), F.lit(1 + 7 * i), F.lit(7)), 16, 10).cast("long") for i in range(9)
    ]
    sums = hashed.groupBy("accession").agg(
        F.count("*").alias("chunks"),
        F.min("_size").alias("dimensions"),
        *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(pieces)],
    )
    return sums.select(
        "accession",
        "chunks",
        "dimensions",
        F.sha2(F.concat_ws(":", "accession", *[F.col(f"_s{i}").cast("string") for i in range(9)]), 256).alias("digest"),
    )


def index_digest(digests: DataFrame, model: str, lowercase: bool) -> DataFrame:
    """One row: a short digest of the embedder and every filing, whatever order they are read in."""
    pieces = [F.conv(F.substr(F.col("digest"), F.lit(1 + 7 * i), F.lit(7)), 16, 10).cast("long") for i in range(9)]
    sums = digests.agg(
        F.count("*").alias("filings"), F.max("dimensions").alias("dimensions"),
        *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(pieces)],
    )
    head = F.lit(f"{model}:{lowercase}")
    text = F.concat_ws(":", head, F.col("dimensions").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(9)])
    return sums.select("filings", "dimensions", F.substr(F.sha2(text, 256), F.lit(1), F.lit(16)).alias("digest"))


def audit(chunks: DataFrame, manifest: DataFrame, dimensions: int) -> DataFrame:
    """One row per filing on either side, with the problems found; empty ``problems`` is sound.

    ``manifest``: accession, chunks, digest.
    """
    checks = chunks.groupBy("accession").agg(
        F.count_if(F.size("vector") != dimensions).alias("_wrong_size"),
        F.count_if(~V.all_finite(F.col("vector"))).alias("_not_finite"),
        F.count_if(~F.startswith(F.col("chunk_id"), F.concat("accession", F.lit(":")))).alias("_wrong_prefix"),
        (F.count("*") - F.count_distinct("ordinal")).alias("_repeated_ordinal"),
    )
    found = filing_digests(chunks).join(checks, "accession")
    listed = manifest.select("accession", F.col("chunks").alias("_listed"), F.col("digest").alias("_listed_digest"))
    joined = found.join(listed, "accession", "full_outer")

    def flag(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(name))

    problems = F.array_compact(
        F.array(
            flag(F.col("_listed").isNull(), "not_in_manifest"),
            flag(F.col("chunks").isNull(), "missing"),
            flag(F.col("chunks") != F.col("_listed"), "count"),
            flag(F.col("_wrong_size") > 0, "dimensions"),
            flag(F.col("_not_finite") > 0, "not_finite"),
            flag(F.col("_wrong_prefix") > 0, "chunk_id_prefix"),
            flag(F.col("_repeated_ordinal") > 0, "repeated_ordinal"),
            flag(F.col("digest") != F.col("_listed_digest"), "digest"),
        )
    )
    return joined.select("accession", F.coalesce("chunks", F.lit(0)).alias("chunks"), problems.alias("problems"))


def scope_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Filings to be written whose (cik, fiscal_year) another accession already holds, with one
    such accession. The index is reduced to one row per scope first, so no pairs are formed."""
    held = existing.groupBy("cik", "fiscal_year").agg(
        F.min("accession").alias("_least"), F.max("accession").alias("_most")
    )
    other = F.when(F.col("_least") != F.col("accession"), F.col("_least")).when(
        F.col("_most") != F.col("accession"), F.col("_most")
    )
    joined = incoming.join(held, ["cik", "fiscal_year"]).withColumn("held_by", other)
    return joined.where(F.col("held_by").isNotNull()).drop("_least", "_most")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def vector_sizes(chunks: DataFrame) -> DataFrame:
    """One row per vector size in use; a sound index has one."""
    return chunks.groupBy(F.size("vector").alias("dimensions")).agg(F.count("*").alias("chunks"))


def fingerprint_differs(stored: DataFrame, model: str, lowercase: bool, dimensions: int) -> DataFrame:
    """The stored fingerprint row when it is not the one asked for."""
    same = (
        (F.col("model") == model) & (F.col("lowercase") == F.lit(lowercase)) & (F.col("dimensions") == dimensions)
    )
    return stored.where(~F.coalesce(same, F.lit(False)))


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("accession").agg(F.count("*").alias("chunks"), F.max(F.size("vector")).alias("dimensions"))


def split_sanity(chunks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Whether each filing's split into items can grade a cited item.

    ``chunks``: accession, item, text. ``expected``: accession, expected_item (nullable)."""
    items = chunks.groupBy("accession", "item").agg(F.sum(F.length("text")).alias("size"))
    real = F.col("item") != S.FULL_FILING
    filings = items.groupBy("accession").agg(
        F.count_if(real).alias("sections"), F.sum("size").alias("total"), F.max("size").alias("largest")
    )
    sound = (
        (F.col("sections") >= S.MIN_SECTIONS)
        & (F.col("total") > 0)
        & (F.col("largest") <= S.MAX_SECTION_SHARE * F.col("total"))
    )
    checked = filings.withColumn("split_is_sane", sound)
    if expected is None:
        return checked
    present = items.where(real).select("accession", F.col("item").alias("expected_item"), F.lit(True).alias("_present"))
    return (
        expected.join(checked, "accession", "left")
        .join(present, ["accession", "expected_item"], "left")
        .withColumn(
            "split_is_sane",
            F.coalesce("split_is_sane", F.lit(False)) & (F.col("expected_item").isNull() | F.coalesce("_present", F.lit(False))),
        )
        .drop("_present")
    )

"""Structured Streaming jobs: questions answered as they arrive, and the log of requests watched.

Each takes a streaming DataFrame. Results a later batch can change are written per batch, under
the batch's number, so a batch run again after a failure replaces its own rows and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from proofline import schemas as S
from proofline.operators import gates as G
from proofline.operators import retrieval as R
from proofline.sources import store as ST


def file_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame) -> DataFrame:
    """Files of a folder as a stream, with the schema of a table already known. A name that fits may be a
    file, or a folder of part files, whose names are its own."""
    # In braces any name is a pattern; without one a stream is read from folders only.
    return spark.readStream.schema(like.schema).parquet(f"{folder}/{{{pattern}}}")


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, str], None],
    path: str,
    mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``write(batch, folder of the batch)`` for every batch. Progress is kept under ``path``."""

    def batch(rows: DataFrame, number: int) -> None:
        write(rows, f"{path}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{path}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Every row written so far, with its ``batch``; none where no batch has come."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    try:
        return spark.read.schema(f"{columns}, batch BIGINT").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{columns}, batch BIGINT")


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


# --- questions -----------------------------------------------------------------------------------
def answer_questions(
    questions: DataFrame,
    filings: DataFrame,
    chunks: DataFrame,
    path: str,
    gate: Callable[[Column, Column, Column], Column] | None = None,
    k: int = S.DEFAULT_TOP_K,
) -> StreamingQuery:
    """Each arriving question (question_id, question, cik, fiscal_year, vector) is resolved,
    searched and gated; the decision is appended. Ranks need a whole batch, so a batch is handled
    as a table."""
    decide = gate or default_gate

    def decisions(rows: DataFrame, folder: str) -> None:
        append(decided(rows, filings, lambda asked: R.scoped_topk(asked, chunks, k), decide), folder)

    return start(questions, decisions, path)


def answer_from_index(
    questions: DataFrame,
    index: str,
    path: str,
    gate: Callable[[Column, Column, Column], Column] | None = None,
    k: int = S.DEFAULT_TOP_K,
    version: int | None = None,
) -> StreamingQuery:
    """``answer_questions`` over a stored index (``sources.store``), at ``version`` or, if none is
    named, at the version that is the newest when a batch begins.

    A batch reads the stored blocks of the buckets its filings are in, where they lie: its questions are
    sent there, and no passage is blocked or moved again.
    """
    decide = gate or default_gate

    def decisions(rows: DataFrame, folder: str) -> None:
        spark = rows.sparkSession
        at = ST.newest_version(spark, index) if version is None else version
        filings = ST.read_filings(spark, index, at).select("cik", "fiscal_year", "accession")

        def search(asked: DataFrame) -> DataFrame:
            return R.blocks_topk(asked, ST.read_blocks(spark, index, at, asked), k)

        append(decided(rows, filings, search, decide), folder)

    return start(questions, decisions, path)


def default_gate(question: Column, year: Column, best: Column) -> Column:
    return G.all_of(G.period_guard(question, year), G.cosine_gate(best))


def decided(
    questions: DataFrame,
    filings: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    decide: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """Questions with their filing, best passages and decision. ``search`` ranks the passages of
    questions (question_id, accession, vector)."""
    scoped = R.resolve_scope(questions, filings)
    inside = scoped.where(~F.col("out_of_scope"))
    top = search(inside.select("question_id", "accession", "vector"))
    best = top.groupBy("question_id").agg(
        F.round(F.max("score"), S.SCORE_DIGITS).alias("best_score"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]
        ).alias("retrieved"),
    )
    judged = scoped.join(best, "question_id", "left").withColumn(
        "_d", decide(F.col("question"), F.col("filing_year"), F.coalesce("best_score", F.lit(0.0)))
    )
    outside = F.col("out_of_scope")
    return judged.select(
        "question_id",
        "accession",
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.coalesce("retrieved", F.array()).alias("retrieved"),
        (~outside & F.coalesce("_d.admitted", F.lit(False))).alias("admitted"),
        F.when(outside, F.lit("out_of_scope")).when(~F.col("_d.admitted"), F.col("_d.rejection")).alias("reason"),
    )


# --- request log ---------------------------------------------------------------------------------
def log_windows(
    log: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Requests per time window and reason: count, abstentions, mean seconds, tokens. Rows later
    than ``delay`` are left out of windows already closed."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = log.withWatermark("ts", delay).groupBy(window.alias("w"), "reason").agg(
        F.count("*").alias("requests"),
        F.count_if("abstained").alias("abstained"),
        F.sum("seconds").alias("seconds"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
    )
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "reason",
        "requests", "abstained", "seconds", "prompt_tokens",
    )


def latest_windows(rows: DataFrame) -> DataFrame:
    """The last state written of every window."""
    keys = ["window_start", "window_end", "reason"]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def without_duplicates(log: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Requests seen for the first time; a repeat within the watermark is dropped."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def user_sessions(log: DataFrame, user: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """A user's requests with no longer pause than ``gap`` between them, once the session is over."""
    sessions = log.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), user).agg(
        F.count("*").alias("requests"), F.sum("seconds").alias("seconds")
    )
    return sessions.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests", "seconds")


def append_records(records: DataFrame, path: str) -> StreamingQuery:
    """Case records appended as they are made; ``writers.compact_records`` sorts them later."""
    return start(records, append, path)


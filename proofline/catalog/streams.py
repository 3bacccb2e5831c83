"""Queries that replay the given tables as streams until everything available is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.catalog.compare import REGISTRY
from proofline.catalog.tables import table
from proofline.operators import gates as G
from proofline.session import scratch_path
from proofline.sources import store as ST
from proofline.streaming import jobs as J


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    events = J.file_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("reason"),
        (F.col("event_type") == "error").alias("abstained"), (F.col("value") * 100).cast("long").alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"),
    )


def _run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    J.start(stream, J.append, path, mode).awaitTermination()
    return J.written(spark, path, stream)


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


WINDOW_SQL = """
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL {length}, '%Y-%m-%d %H:%M:%S') AS window_end,
    reason, count(*) AS requests, count(*) FILTER (reason = 'error') AS abstained,
    sum(trunc(value * 100)::BIGINT)::BIGINT AS seconds, sum(k)::BIGINT AS prompt_tokens
  FROM (SELECT {start} AS s, event_type AS reason, value, (props->>'$.k')::BIGINT AS k FROM events) e GROUP BY ALL
"""


@REGISTRY.query("stream_log_windows", WINDOW_SQL.format(length="1 hour", start="time_bucket(INTERVAL 1 hour, ts)"))
def stream_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.latest_windows(_run(J.log_windows(_log(spark, sf_dir)), "log-windows", "update"))
    return rows.withColumns({c: _time(c) for c in ("window_start", "window_end")})


@REGISTRY.query(
    "stream_log_sliding",
    WINDOW_SQL.format(length="2 hours", start="time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour * unnest([0, 1])"),
)
def stream_log_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = J.log_windows(_log(spark, sf_dir), "2 hours", "1 hour")
    rows = J.latest_windows(_run(stream, "log-sliding", "update"))
    return rows.withColumns({c: _time(c) for c in ("window_start", "window_end")})


@REGISTRY.query("stream_dedup", "SELECT event_id // 2 AS request, count(DISTINCT event_id // 2) AS requests FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two neighbouring events are one request sent twice.
    log = _log(spark, sf_dir).withColumn("request", F.floor(F.col("event_id") / 2))
    rows = _run(J.without_duplicates(log.select("request", "ts"), "request", "1 day"), "dedup")
    return rows.groupBy("request").agg(F.count("*").alias("requests"))


@REGISTRY.query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, trunc(value * 100)::BIGINT AS sec,
                 CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minutes THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
       g AS (SELECT user_id, n, min(ts) AS a, max(ts) + INTERVAL 30 minutes AS b, count(*) AS requests, sum(sec)::BIGINT AS seconds FROM s GROUP BY 1, 2)
       SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, requests, seconds
       FROM g WHERE b <= (SELECT max(ts) - INTERVAL 10 minutes FROM events)""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(J.user_sessions(_log(spark, sf_dir), "user_id"), "sessions")
    return rows.drop("batch").withColumns({c: _time(c) for c in ("session_start", "session_end")})


@REGISTRY.query(
    "stream_questions",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 12 AS asked, 1994 + (vec_id % 9)::INT AS y FROM embeddings),
       f AS (SELECT DISTINCT label FROM embeddings),
       s AS (SELECT q.vec_id, q.asked, q.y, round(max(list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e))), 4) AS best
             FROM v q LEFT JOIN v c ON c.label = q.asked GROUP BY 1, 2, 3)
       SELECT vec_id AS question_id, label AS accession, coalesce(best, 0) AS best_score,
         (label IS NOT NULL AND y BETWEEN 1993 + label % 7 AND 1995 + label % 7 AND best >= 0.3)::INT AS admitted,
         CASE WHEN label IS NULL THEN 'out_of_scope' WHEN y NOT BETWEEN 1993 + label % 7 AND 1995 + label % 7 THEN 'out_of_period'
              WHEN best < 0.3 THEN 'gate_rejected' END AS reason
       FROM s LEFT JOIN f ON label = asked""",
)
def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.select(
        F.col("label").alias("accession"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector")
    )
    filings = vectors.select(
        F.col("label").cast("long").alias("cik"), (1995 + F.col("label") % 7).cast("int").alias("fiscal_year"), F.col("label").alias("accession")
    ).distinct()
    arriving = J.file_stream(spark, sf_dir, "embeddings.parquet", vectors).select(
        F.col("vec_id").alias("question_id"),
        F.concat(F.lit("What was revenue in "), (1994 + F.col("vec_id") % 9).cast("string"), F.lit("?")).alias("question"),
        (F.col("vec_id") % 12).alias("cik"),
        F.lit(None).cast("int").alias("fiscal_year"),
        F.col("embedding").alias("vector"),
    )
    gate = lambda q, y, best: G.all_of(G.period_guard(q, y), G.cosine_gate(best, 0.3))
    path, index = scratch_path(spark, "questions"), scratch_path(spark, "questions-index")
    ST.write_filings(chunks, filings, index, buckets=8)
    J.answer_from_index(arriving, index, path, gate).awaitTermination()
    like = spark.createDataFrame(
        [], "question_id BIGINT, accession INT, best_score DOUBLE, retrieved ARRAY<BIGINT>, admitted BOOLEAN, reason STRING"
    )
    rows = J.written(spark, path, like)
    return rows.select("question_id", "accession", "best_score", F.col("admitted").cast("int").alias("admitted"), "reason")

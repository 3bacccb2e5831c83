"""A run judged case by case and compared with a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions.statistics import wilson
from proofline.operators.arms import COSINE, answered, correct, passes

END_TO_END_ARMS = ("A", "B", "D", "F")
GATE_ARMS = ("B", "D", "F")
UNANSWERABLE = "unanswerable"


def judge(records: DataFrame, threshold: float = S.DEFAULT_COSINE_THRESHOLD) -> DataFrame:
    """(id, tier, label, outcome, right): the arms that got each golden case right.

    End to end, right means answered correctly or, for an unanswerable case, not answered. In the
    gate tier nothing is generated, so right means admitted exactly when answerable.
    """
    e2e = F.col("e2e")

    def right(key: str) -> Column:
        admits = passes(key, {COSINE: threshold})
        answers = admits & answered()
        whole = F.when(F.col("answerable"), answers & correct()).otherwise(~answers)
        gate = (admits == F.col("answerable")) if key in GATE_ARMS else F.lit(False)
        return F.when(F.when(e2e, whole).otherwise(gate), F.lit(key))

    return records.where(F.col("kind") == "golden").select(
        "id",
        F.when(e2e, F.lit("e2e")).otherwise(F.lit("gate-only")).alias("tier"),
        F.when(F.col("answerable"), F.lit("answerable")).otherwise(F.col("negative_kind")).alias("label"),
        "outcome",
        F.array_compact(F.array(*[right(key) for key in END_TO_END_ARMS])).alias("right"),
    )


def matched(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Both judgements of every case id; a case missing on one side has nulls there."""
    old = baseline.select(
        "id", F.col("outcome").alias("old_outcome"), F.col("right").alias("old_right")
    )
    return current.join(old, "id", "full_outer")


def stale(pairs: DataFrame) -> DataFrame:
    """One row: how many cases the baseline has alone, and how many the run has alone."""
    return pairs.agg(
        F.count_if(F.col("outcome").isNull()).alias("gone"),
        F.count_if(F.col("old_outcome").isNull()).alias("new"),
    )


def changes(pairs: DataFrame) -> DataFrame:
    """Cases each arm now gets wrong or right, by tier and label, with the net change.

    Every unanswerable case also counts in the group of all unanswerable ones.
    """
    both = pairs.where(F.col("outcome").isNotNull() & F.col("old_outcome").isNotNull())
    arms = F.when(F.col("tier") == "e2e", F.array(*map(F.lit, END_TO_END_ARMS))).otherwise(
        F.array(*map(F.lit, GATE_ARMS))
    )
    labels = F.when(F.col("label") == "answerable", F.array("label")).otherwise(
        F.array(F.col("label"), F.lit(UNANSWERABLE))
    )
    moved = (
        both.withColumn("arm", F.explode(arms))
        .withColumn("was", F.array_contains("old_right", F.col("arm")))
        .withColumn("now", F.array_contains("right", F.col("arm")))
        .where(F.col("was") != F.col("now"))
        .withColumn("group", F.explode(labels))
    )
    counts = moved.groupBy("tier", "group", "arm").agg(
        F.count_if("was").alias("worse"), F.count_if("now").alias("better")
    )
    net = F.col("worse") - F.col("better")
    return counts.select(
        "*", net.alias("net"), (F.abs(net) >= S.NET_CHANGE_LIMIT).alias("fails")
    )


def transitions(pairs: DataFrame) -> DataFrame:
    """Outcome changes, and how many of them left every arm's judgement as it was."""
    both = pairs.where(F.col("outcome") != F.col("old_outcome"))
    return both.groupBy("old_outcome", "outcome").agg(
        F.count("*").alias("cases"), F.count_if(F.col("old_right") == F.col("right")).alias("silent")
    )


def verdict(
    pairs: DataFrame, baseline_threshold: float, threshold: float = S.DEFAULT_COSINE_THRESHOLD
) -> DataFrame:
    """One row: passed, and what failed. A changed threshold or case list fails on its own."""
    failing = changes(pairs).agg(
        F.count_if(F.col("net") >= S.NET_CHANGE_LIMIT).alias("worsened_groups"),
        F.count_if(-F.col("net") >= S.NET_CHANGE_LIMIT).alias("improved_groups"),
    )
    row = stale(pairs).crossJoin(F.broadcast(failing))
    same = F.lit(baseline_threshold == threshold)
    fresh = (F.col("gone") == 0) & (F.col("new") == 0) & same
    return row.select(
        "*",
        same.alias("same_threshold"),
        (fresh & (F.col("worsened_groups") == 0) & (F.col("improved_groups") == 0)).alias("passed"),
    )


def half_widths(judged: DataFrame) -> DataFrame:
    """What the end-to-end tier cannot see: the interval half-width at one half, by label."""
    counts = judged.where(F.col("tier") == "e2e").groupBy("label").agg(F.count("*").alias("n"))
    interval = wilson(F.floor(F.col("n") / 2), F.col("n"))
    return counts.select("label", "n", ((interval["high"] - interval["low"]) / 2).alias("half_width"))

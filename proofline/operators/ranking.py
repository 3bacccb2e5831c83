"""Ranking statistics over scored, labelled rows: AUROC, thresholds, risk and coverage.

Inputs are long tables; ``by`` names optional grouping columns, each group getting its own answer.
Everything starts from a histogram by score (aggregated before the shuffle), so cost follows the
number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.operators.running import running_totals


def invalid_scores(cases: DataFrame, score: str = "score") -> DataFrame:
    """Rows whose score is missing or not finite."""
    value = F.col(score).cast("double")
    return cases.where(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))


def histogram(cases: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each score."""
    positive = F.col(label).cast("int")
    return cases.groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.sum(positive).cast("long").alias("pos"), F.sum(1 - positive).cast("long").alias("neg")
    )


def midranks(cases: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Each distinct score with the mean rank its ties share."""
    counts = cases.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count("*").alias("n"))
    through = running_totals(counts, "score", ["n"], by)
    return through.select(
        *(by or []), "score", "n",
        (F.col("n_through") - F.col("n") + (F.col("n") + 1) / 2).alias("midrank"),
    )


def auroc_of_histogram(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUROC from a table of (by, score, pos, neg): the share of positive-negative pairs that are
    ranked right, ties counting half. Null where a class is empty."""
    by = by or []
    below = running_totals(hist, "score", ["neg"], by)
    wins = F.col("pos") * (F.col("neg_through") - F.col("neg") * F.lit(0.5))
    sums = below.groupBy(*by).agg(
        F.sum(wins).alias("_u"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative")
    )
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return sums.select(
        *by, "n_positive", "n_negative", F.when(pairs > 0, F.col("_u") / pairs).alias("auroc")
    )


def auroc(cases: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    return auroc_of_histogram(histogram(cases, score, label, by), by)


def kth_position(n: Column, target: float) -> Column:
    """ceil(target * n), with the allowance that keeps 0.07 * 100 at seven."""
    return F.ceil(F.lit(target) * n - F.lit(1e-9)).cast("long")


def threshold_at_recall(
    positives: DataFrame,
    score: str,
    target: float = S.TARGET_RECALL,
    by: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The highest threshold that admits ``target`` of the positives: the k-th largest score."""
    if not 0.0 < target <= 1.0:
        raise ValueError(f"target must be in (0, 1], got {target}")
    by = by or []
    size = F.sum(weight) if weight else F.count("*")
    counts = positives.groupBy(*by, F.col(score).alias("score")).agg(size.cast("long").alias("n"))
    through = running_totals(counts, "score", ["n"], by, descending=True)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n_positive"))
    joined = through.join(sizes, by) if by else through.crossJoin(F.broadcast(sizes))
    reached = joined.where(F.col("n_through") >= kth_position(F.col("n_positive"), target))
    return reached.groupBy(*by, "n_positive").agg(F.max("score").alias("threshold"))


def crossfit_thresholds(
    cases: DataFrame, score: str, label: str, fold: str, target: float = S.TARGET_RECALL
) -> DataFrame:
    """(fold, threshold): each fold's threshold is fitted on the positives of the other folds."""
    counts = (
        cases.where(F.col(label))
        .groupBy(F.col(fold).alias("_from"), F.col(score).alias("score"))
        .agg(F.count("*").alias("n"))
    )
    folds = cases.select(F.col(fold).alias("fold")).distinct()
    # Folds are 0 and 1 (``quality.golden_rules``): two rows.
    others = counts.join(F.broadcast(folds), F.col("_from") != F.col("fold"))
    fitted = threshold_at_recall(others, "score", target, ["fold"], weight="n")
    return fitted.select("fold", "threshold", F.col("n_positive").alias("fitted_on"))


def mixed_folds(cases: DataFrame, fold: str) -> DataFrame:
    """One row when some cases have a fold and others do not, else none."""
    counts = cases.agg(
        F.count_if(F.col(fold).isNull()).alias("without_fold"),
        F.count(fold).alias("with_fold"),
    )
    return counts.where((F.col("without_fold") > 0) & (F.col("with_fold") > 0))


def admit(cases: DataFrame, thresholds: DataFrame, score: str, fold: str) -> DataFrame:
    """``cases`` with ``admitted`` under the threshold of their own fold; null where the fold has
    no threshold. Folds are 0, 1 or none, one row each, and the join leaves the cases where they are."""
    cut = thresholds.select(F.col("fold").alias("_fold"), F.col("threshold").alias("_threshold"))
    joined = cases.join(F.broadcast(cut), F.col(fold).eqNullSafe(F.col("_fold")), "left")
    return joined.withColumn("admitted", F.col(score) >= F.col("_threshold")).drop("_fold", "_threshold")


def operating_point(
    cases: DataFrame, score: str, label: str, fold: str, target: float = S.TARGET_RECALL
) -> DataFrame:
    """False-accept rate and realised recall at the cross-fitted thresholds."""
    thresholds = crossfit_thresholds(cases, score, label, fold, target)
    admitted = admit(cases, thresholds, score, fold)
    hit = F.col("admitted").cast("double")
    return admitted.agg(
        F.avg(F.when(~F.col(label), hit)).alias("false_accept_rate"),
        F.avg(F.when(F.col(label), hit)).alias("recall"),
        F.count_if(F.col(label)).alias("n_positive"),
        F.count_if(~F.col(label)).alias("n_negative"),
    )


def risk_coverage_curve(
    cases: DataFrame, score: str, correct: str, by: list[str] | None = None
) -> DataFrame:
    """One point per distinct score: answer everything scoring at least that much."""
    by = by or []
    counts = cases.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("errors")
    )
    through = running_totals(counts, "threshold", ["n", "errors"], by, descending=True)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    joined = through.join(sizes, by) if by else through.crossJoin(F.broadcast(sizes))
    return joined.select(
        *by,
        "threshold",
        (F.col("n_through") / F.col("_total")).alias("coverage"),
        (F.col("errors_through") / F.col("n_through")).alias("risk"),
        (F.col("n") / F.col("_total")).alias("added_coverage"),
    )


def risk_coverage_area(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the curve: each point's risk weighted by the coverage it adds."""
    return curve.groupBy(*(by or [])).agg(
        F.sum(F.col("added_coverage") * F.col("risk")).alias("area"),
        F.count("*").alias("points"),
    )


def risk_at_coverage(
    curve: DataFrame, targets: tuple[float, ...] = S.COVERAGE_POINTS, by: list[str] | None = None
) -> DataFrame:
    """Risk at the first point reaching each coverage, or at the last point."""
    by = by or []
    point = F.struct("risk", "coverage")
    # One aggregate per target, all in a single pass over the curve.
    picks = [
        F.coalesce(
            F.min_by(F.when(F.col("coverage") >= t, point), F.when(F.col("coverage") >= t, F.col("coverage"))),
            F.max_by(point, "coverage"),
        ).alias(f"_at_{i}")
        for i, t in enumerate(targets)
    ]
    row = curve.groupBy(*by).agg(*picks)
    at = F.explode(
        F.array(
            *[F.struct(F.lit(float(t)).alias("target"), F.col(f"_at_{i}").alias("at")) for i, t in enumerate(targets)]
        )
    )
    return row.select(*by, at.alias("p")).select(*by, "p.target", "p.at.risk", "p.at.coverage")

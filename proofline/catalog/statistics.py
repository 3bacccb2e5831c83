"""Queries over case records: rates, ranking, thresholds, bootstrap, arms, regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.catalog.compare import REGISTRY
from proofline.catalog.tables import CASES_SQL, cases, table
from proofline.functions import statistics as ST
from proofline.operators import arms as A
from proofline.operators import bootstrap as B
from proofline.operators import ranking as R
from proofline.operators import regression as G
from proofline.operators import selection as SEL
from proofline.session import materialize

Z = repr(ST.normal_quantile(0.975))
COSINE_CUT = 100.0
RESAMPLES = S.RESAMPLES


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, so both engines print the same value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("cosine", F.col("scores")["cosine"])


@REGISTRY.query(
    "wilson_by_type",
    f"""
    WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (value >= 100) AS hits FROM events GROUP BY 1),
    p AS (SELECT *, hits::DOUBLE / n AS p, {Z} * {Z} / n AS z2n FROM c)
    SELECT event_type, n, hits, round(p, 6) AS point,
      round(CASE WHEN hits = 0 THEN 0 ELSE greatest(0, ((p + z2n / 2) - {Z} * sqrt(p * (1 - p) / n + z2n / (4 * n))) / (1 + z2n)) END, 6) AS low,
      round(CASE WHEN hits = n THEN 1 ELSE least(1, ((p + z2n / 2) + {Z} * sqrt(p * (1 - p) / n + z2n / (4 * n))) / (1 + z2n)) END, 6) AS high
    FROM p""",
)
def wilson_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("hits")
    )
    rate = ST.wilson(F.col("hits"), F.col("n"))
    return _rounded(counts.select("event_type", "n", "hits", rate["point"].alias("point"), rate["low"].alias("low"), rate["high"].alias("high")))


AUROC_SQL = """
  SELECT {by} count(*) FILTER (label) AS n_positive, count(*) FILTER (NOT label) AS n_negative,
    round((sum(mr) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0)
      / (count(*) FILTER (label)::DOUBLE * count(*) FILTER (NOT label)), 6) AS auroc
  FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({tie}) - 1) / 2.0 AS mr FROM s) t
"""


@REGISTRY.query(
    "auroc_by_score",
    "WITH "
    + CASES_SQL
    + ", s AS (SELECT fold, cosine AS score, answerable AS label FROM cases WHERE kind = 'golden')"
    + AUROC_SQL.format(by="fold,", part="PARTITION BY fold", tie="PARTITION BY fold, score")
    + " GROUP BY fold",
)
def auroc_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = _flat(spark, sf_dir).where(F.col("kind") == "golden")
    return _rounded(R.auroc(golden, "cosine", "answerable", ["fold"]).select("fold", "n_positive", "n_negative", "auroc"))


@REGISTRY.query(
    "auroc_documents",
    "WITH s AS (SELECT n_chars AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"
    + AUROC_SQL.format(by="", part="", tie="PARTITION BY score"),
)
def auroc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = labelled.select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("label"))
    return _rounded(R.auroc(scored, "score", "label"))


@REGISTRY.query(
    "midranks",
    """SELECT DISTINCT value AS score, count(*) OVER (PARTITION BY value) AS n,
         rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS midrank
       FROM events""",
)
def midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.midranks(table(spark, sf_dir, "events"), "value")


THRESHOLDS_SQL = """
, folds AS (SELECT DISTINCT fold AS for_fold FROM golden),
ranked AS (
  SELECT for_fold, score, row_number() OVER (PARTITION BY for_fold ORDER BY score DESC) AS r,
         count(*) OVER (PARTITION BY for_fold) AS n
  FROM folds JOIN golden ON fold <> for_fold WHERE answerable),
cuts AS (
  SELECT for_fold AS fold, score AS threshold, n AS fitted_on FROM ranked
  WHERE r = ceil(0.9 * n - 1e-9)::BIGINT)
"""
GOLDEN_SQL = ", golden AS (SELECT fold, answerable, ticker, cosine AS score FROM cases WHERE kind = 'golden')"


@REGISTRY.query(
    "crossfit_threshold",
    "WITH " + CASES_SQL + GOLDEN_SQL + THRESHOLDS_SQL + "SELECT fold, threshold, fitted_on FROM cuts",
)
def crossfit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = _flat(spark, sf_dir).where(F.col("kind") == "golden")
    return R.crossfit_thresholds(golden, "cosine", "answerable", "fold")


@REGISTRY.query(
    "operating_point",
    "WITH " + CASES_SQL + GOLDEN_SQL + THRESHOLDS_SQL
    + """SELECT round(avg((score >= threshold)::INT) FILTER (NOT answerable), 6) AS false_accept_rate,
           round(avg((score >= threshold)::INT) FILTER (answerable), 6) AS recall,
           count(*) FILTER (answerable) AS n_positive, count(*) FILTER (NOT answerable) AS n_negative
         FROM golden JOIN cuts USING (fold)""",
)
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = _flat(spark, sf_dir).where(F.col("kind") == "golden")
    return _rounded(R.operating_point(golden, "cosine", "answerable", "fold"))


CURVE_SQL = """
, e2e AS (SELECT cosine AS score, CASE WHEN answerable THEN correct ELSE NOT answered END AS ok
          FROM cases WHERE kind = 'golden' AND e2e),
curve AS (
  SELECT DISTINCT score, count(*) OVER w / (count(*) OVER ())::DOUBLE AS coverage,
         count(*) FILTER (NOT ok) OVER w / (count(*) OVER w)::DOUBLE AS risk
  FROM e2e WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stepped AS (SELECT *, coverage - lag(coverage, 1, 0.0) OVER (ORDER BY score DESC) AS added FROM curve)
"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e2e = A.end_to_end(_flat(spark, sf_dir)).withColumn("ok", A.decision_correct())
    return R.risk_coverage_curve(e2e, "cosine", "ok")


@REGISTRY.query(
    "risk_coverage",
    "WITH " + CASES_SQL + CURVE_SQL + "SELECT round(sum(added * risk), 6) AS area, count(*) AS points FROM stepped",
)
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.risk_coverage_area(_curve(spark, sf_dir)))


@REGISTRY.query(
    "risk_at_coverage",
    "WITH " + CASES_SQL + CURVE_SQL
    + """, t AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS target)
        SELECT target, round(min_by(risk, coverage), 6) AS risk, round(min(coverage), 6) AS coverage
        FROM t JOIN curve ON coverage >= target GROUP BY target""",
)
def risk_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.risk_at_coverage(_curve(spark, sf_dir)))


ARMS_SQL = """
, golden AS (SELECT * FROM cases WHERE kind = 'golden'),
folds AS (SELECT DISTINCT fold AS for_fold FROM golden),
named AS (
  SELECT fold, answerable, 'cosine' AS name, cosine AS score FROM golden
  UNION ALL SELECT fold, answerable, 'recorded', recorded FROM golden),
ranked AS (
  SELECT for_fold, name, score, row_number() OVER (PARTITION BY for_fold, name ORDER BY score DESC) AS r,
         count(*) OVER (PARTITION BY for_fold, name) AS n
  FROM folds JOIN named ON fold <> for_fold WHERE answerable),
cuts AS (SELECT for_fold AS fold, max(score) FILTER (name = 'cosine') AS cut_c, max(score) FILTER (name = 'recorded') AS cut_r
         FROM ranked WHERE r = ceil(0.9 * n - 1e-9)::BIGINT GROUP BY 1),
by_arm AS (
  SELECT g.*, arm, answered AND admitted AS answers, admitted FROM (
    SELECT g.*, unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS arm,
      unnest([true, cosine >= cut_c, recorded >= cut_r, period >= 1, period >= 1 AND recorded >= cut_r,
              period >= 1 AND cosine >= cut_c]) AS admitted
    FROM golden g JOIN cuts USING (fold)) g)
"""


def _by_arm(spark: SparkSession, sf_dir: str, e2e: bool = True) -> DataFrame:
    records = cases(spark, sf_dir)
    thresholds = A.fit_thresholds(records)
    base = A.end_to_end(records) if e2e else records.where(F.col("kind") == "golden")
    return A.with_arms(base, thresholds)


@REGISTRY.query(
    "arms_table",
    "WITH " + CASES_SQL + ARMS_SQL
    + f""", t AS (
      SELECT arm, count(*) FILTER (NOT answerable) AS negatives,
        count(*) FILTER (NOT answerable AND answers) AS false_answers,
        count(*) FILTER (answerable) AS positives,
        count(*) FILTER (answerable AND correct AND NOT admitted) AS recall_cost,
        count(*) FILTER (answerable AND correct AND admitted) AS correct,
        count(*) FILTER (answerable AND answers) AS answered_positives,
        count(*) FILTER (answerable AND answers AND k % 3 <> 0) AS numeric_correct,
        count(*) FILTER (answerable AND answers AND k % 4 <> 0) AS citation_supported,
        round(sum(CASE WHEN admitted AND k % 5 <> 0 THEN value ELSE 0 END) / count(*), 6) AS seconds_per_question,
        count(DISTINCT ticker) AS companies
      FROM by_arm WHERE e2e GROUP BY arm),
    p AS (SELECT *, false_answers::DOUBLE / negatives AS p, {Z} * {Z} / negatives AS z2n FROM t)
    SELECT * EXCLUDE (p, z2n), round(p, 6) AS false_rate,
      round(CASE WHEN false_answers = 0 THEN 0 ELSE greatest(0, ((p + z2n / 2) - {Z} * sqrt(p * (1 - p) / negatives + z2n / (4 * negatives))) / (1 + z2n)) END, 6) AS false_low,
      round(CASE WHEN false_answers = negatives THEN 1 ELSE least(1, ((p + z2n / 2) + {Z} * sqrt(p * (1 - p) / negatives + z2n / (4 * negatives))) / (1 + z2n)) END, 6) AS false_high
    FROM p""",
)
def arms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.arm_table(_by_arm(spark, sf_dir)))


@REGISTRY.query(
    "false_answers_by_kind",
    "WITH " + CASES_SQL + ARMS_SQL
    + "SELECT arm"
    + "".join(
        f", count(*) FILTER (answers AND negative_kind = '{k}') AS {k}_hits, count(*) FILTER (negative_kind = '{k}') AS {k}_n"
        for k in S.NEGATIVE_KINDS
    )
    + " FROM by_arm WHERE e2e AND NOT answerable GROUP BY arm",
)
def false_answers_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.false_answers_by_kind(_by_arm(spark, sf_dir))


@REGISTRY.query(
    "gate_recall",
    "WITH " + CASES_SQL + ARMS_SQL
    + "SELECT arm, round(avg(admitted::INT), 6) AS gate_recall FROM by_arm WHERE answerable GROUP BY arm",
)
def gate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.gate_recall(_by_arm(spark, sf_dir, e2e=False)))


@REGISTRY.query(
    "gate_only",
    "WITH " + CASES_SQL + ARMS_SQL
    + """, gates AS (
        SELECT 'cosine' AS gate, answerable, ticker, cosine AS score, cosine >= cut_c AS ok FROM golden JOIN cuts USING (fold)
        UNION ALL SELECT 'recorded', answerable, ticker, recorded, recorded >= cut_r FROM golden JOIN cuts USING (fold)
        UNION ALL SELECT 'period', answerable, ticker, NULL, period >= 1 FROM golden),
      ranks AS (SELECT *, rank() OVER (PARTITION BY gate ORDER BY score) + (count(*) OVER (PARTITION BY gate, score) - 1) / 2.0 AS mr FROM gates)
      SELECT gate, round(avg(ok::INT) FILTER (NOT answerable), 6) AS false_accept_rate,
        round(avg(ok::INT) FILTER (answerable), 6) AS recall,
        count(*) FILTER (answerable) AS n_positive, count(*) FILTER (NOT answerable) AS n_negative,
        count(DISTINCT ticker) AS companies,
        CASE WHEN gate <> 'period' THEN round((sum(mr) FILTER (answerable) - count(*) FILTER (answerable) * (count(*) FILTER (answerable) + 1) / 2.0)
          / (count(*) FILTER (answerable)::DOUBLE * count(*) FILTER (NOT answerable)), 6) END AS auroc
      FROM ranks GROUP BY gate""",
)
def gate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cases(spark, sf_dir)
    return _rounded(A.gate_only(records, A.fit_thresholds(records)))


DRAWS_SQL = """
, clusters AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS position,
               count(*) OVER (PARTITION BY stratum) AS size
               FROM (SELECT DISTINCT fold::VARCHAR AS stratum, ticker AS cluster FROM base)),
draws AS (
  SELECT b AS replicate, stratum,
    ('0x' || substr(md5('{seed}:' || b || ':' || stratum || ':' || position), 1, 8))::BIGINT % size AS position
  FROM range({resamples}) r(b), clusters)
"""


@REGISTRY.query(
    "bootstrap_mean",
    "WITH " + CASES_SQL
    + ", base AS (SELECT fold, ticker, answered::INT AS v FROM cases WHERE kind = 'golden' AND NOT answerable)"
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + f""", sums AS (SELECT fold::VARCHAR AS stratum, ticker AS cluster, sum(v)::DOUBLE AS total, count(*) AS n FROM base GROUP BY ALL),
      reps AS (SELECT replicate, sum(total) / sum(n) AS v FROM draws JOIN clusters USING (stratum, position) JOIN sums USING (stratum, cluster) GROUP BY 1)
      SELECT round((SELECT avg(v) FROM base), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low,
        round(quantile_cont(v, 0.975), 6) AS high, round(stddev_samp(v), 6) AS standard_error,
        round(stddev_samp(v) * {ST.effect_factor(0.95)!r}, 6) AS mde, count(*) AS replicates, 0 AS undefined
      FROM reps""",
)
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = cases(spark, sf_dir).where((F.col("kind") == "golden") & ~F.col("answerable"))
    valued = negatives.withColumn("v", A.answered().cast("int"))
    return _rounded(B.bootstrap_mean(valued, "v", "ticker", "fold", RESAMPLES))


@REGISTRY.query(
    "bootstrap_auroc",
    "WITH " + CASES_SQL
    + ", base AS (SELECT fold, ticker, answerable, cosine AS score FROM cases WHERE kind = 'golden')"
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + """, w AS (SELECT replicate, cluster, count(*) AS w FROM draws JOIN clusters USING (stratum, position) GROUP BY 1, 2),
      h AS (SELECT replicate, score, sum(w) FILTER (answerable) AS p, sum(w) FILTER (NOT answerable) AS n
            FROM w JOIN base ON ticker = cluster GROUP BY 1, 2),
      c AS (SELECT replicate, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
              sum(coalesce(n, 0)) OVER (PARTITION BY replicate ORDER BY score) AS below FROM h),
      a AS (SELECT replicate, sum(p * (below - 0.5 * n)) / (sum(p)::DOUBLE * sum(n)) AS v FROM c GROUP BY 1)
      SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high,
        round(stddev_samp(v), 6) AS standard_error, count(*) AS replicates FROM a""",
)
def bootstrap_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = _flat(spark, sf_dir).where(F.col("kind") == "golden")
    replicates = B.auroc_replicates(golden, "cosine", "answerable", "ticker", "fold", RESAMPLES)
    return _rounded(B.interval(replicates).select("low", "high", "standard_error", "replicates"))


def _auroc_replicates_sql(name: str, score: str) -> str:
    return f"""
      {name}_h AS (SELECT replicate, {score} AS score, sum(w) FILTER (answerable) AS p, sum(w) FILTER (NOT answerable) AS n
            FROM w JOIN base ON ticker = cluster GROUP BY 1, 2),
      {name}_c AS (SELECT replicate, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
              sum(coalesce(n, 0)) OVER (PARTITION BY replicate ORDER BY score) AS below FROM {name}_h),
      {name} AS (SELECT replicate, sum(p * (below - 0.5 * n)) / (sum(p)::DOUBLE * sum(n)) AS v FROM {name}_c GROUP BY 1)"""


@REGISTRY.query(
    "auroc_difference",
    "WITH " + CASES_SQL
    + ", base AS (SELECT fold, ticker, answerable, cosine, recorded FROM cases WHERE kind = 'golden')"
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + ", w AS (SELECT replicate, cluster, count(*) AS w FROM draws JOIN clusters USING (stratum, position) GROUP BY 1, 2),"
    + _auroc_replicates_sql("first", "cosine") + "," + _auroc_replicates_sql("second", "recorded")
    + """, d AS (SELECT f.v - s.v AS v FROM first f JOIN second s USING (replicate))
      SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high,
        round(stddev_samp(v), 6) AS standard_error, count(*) AS replicates FROM d""",
)
def auroc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = _flat(spark, sf_dir).where(F.col("kind") == "golden").withColumn("recorded", F.col("scores")["recorded"])
    first, second = (B.auroc_replicates(golden, score, "answerable", "ticker", "fold", RESAMPLES) for score in ("cosine", "recorded"))
    replicates = B.auroc_difference_replicates(first, second)
    return _rounded(B.interval(replicates).select("low", "high", "standard_error", "replicates"))


TRIM = 0.2


def _trimmed(state: np.ndarray) -> float:
    """Mean of values 1 to n, met as often as ``state`` says, without a fifth of them at either end."""
    ends = np.cumsum(state)
    cut = np.floor(TRIM * ends[-1])
    kept = np.clip(ends, cut, ends[-1] - cut)
    return float((np.diff(kept, prepend=cut) * np.arange(1, len(state) + 1)).sum() / (ends[-1] - 2 * cut))


PRIORITIES = [f"p{i}" for i in range(1, 6)]
TRIMMED_MEAN = B.UserAggregate(lambda rows, weights: weights @ rows[PRIORITIES].to_numpy(), _trimmed)


@REGISTRY.query(
    "bootstrap_trimmed_mean",
    """WITH base AS (SELECT (o_custkey % 2)::VARCHAR AS fold, o_custkey AS ticker, 1 + o_orderkey % 5 AS v FROM orders)"""
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + f""", counted AS (
        SELECT replicate, v, count(*) AS n FROM draws JOIN clusters USING (stratum, position) JOIN base ON ticker = cluster GROUP BY ALL),
      ends AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY replicate) AS total FROM counted),
      reps AS (
        SELECT replicate, sum(v * (least(greatest(upto, floor({TRIM} * total)), total - floor({TRIM} * total))
                 - least(greatest(upto - n, floor({TRIM} * total)), total - floor({TRIM} * total)))) / any_value(total - 2 * floor({TRIM} * total)) AS v
        FROM ends GROUP BY replicate)
      SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high,
        round(stddev_samp(v), 6) AS standard_error, count(*) AS replicates FROM reps""",
)
def bootstrap_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's statistic: the trimmed mean of a five-valued mark of orders, customers drawn whole."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).alias("fold"), F.col("o_custkey").alias("ticker"), (1 + F.col("o_orderkey") % 5).alias("v"))
    marks = [F.count_if(F.col("v") == i).alias(name) for i, name in enumerate(PRIORITIES, 1)]
    replicates = B.cluster_bootstrap(orders.groupBy("fold", "ticker").agg(*marks), TRIMMED_MEAN, "ticker", "fold", RESAMPLES)
    return _rounded(B.interval(replicates).select("low", "high", "standard_error", "replicates"))


@REGISTRY.query(
    "paired_difference",
    "WITH " + CASES_SQL + ARMS_SQL
    + """, pairs AS (
        SELECT id, bool_or(answers) FILTER (arm = 'E') AS f, bool_or(answers) FILTER (arm = 'F') AS s
        FROM by_arm WHERE e2e AND NOT answerable GROUP BY id)
      SELECT count(*) FILTER (f AND NOT s) AS first_only, count(*) FILTER (NOT f AND s) AS second_only,
        count(*) AS cases, round(avg(f::INT - s::INT), 6) AS difference FROM pairs""",
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = _by_arm(spark, sf_dir).where(~F.col("answerable"))
    return _rounded(A.discordant(A.paired(negatives, "E", "F")).drop("p_value"))


@REGISTRY.query(
    "mcnemar_by_user",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click' AND value >= 100) AS b,
                  count(*) FILTER (event_type = 'view' AND value >= 100) AS c FROM events GROUP BY 1)
       SELECT user_id, b, c,
         round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
           lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 6) AS p_value
       FROM c""",
)
def mcnemar_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("value") >= 100
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "click") & high).alias("b"), F.count_if((F.col("event_type") == "view") & high).alias("c")
    )
    return _rounded(counts.select("user_id", "b", "c", ST.mcnemar_exact("b", "c").alias("p_value")))


JUDGED_SQL = """
, judged AS (
  SELECT id // 2 AS id, id % 2 AS half, CASE WHEN e2e THEN 'e2e' ELSE 'gate-only' END AS tier,
    CASE WHEN answerable THEN 'answerable' ELSE negative_kind END AS label, outcome, answerable,
    list_filter(['A', 'B', 'D', 'F'], lambda a, i:
      CASE WHEN e2e THEN CASE WHEN answerable THEN adm[i] AND answered AND correct ELSE NOT (adm[i] AND answered) END
           ELSE a <> 'A' AND adm[i] = answerable END) AS right
  FROM (SELECT *, [true, cosine >= 100, period >= 1, period >= 1 AND cosine >= 100] AS adm FROM cases) c),
pairs AS (
  SELECT n.*, o.outcome AS old_outcome, o.right AS old_right
  FROM (SELECT * FROM judged WHERE half = 1) n JOIN (SELECT * FROM judged WHERE half = 0) o USING (id))
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cases(spark, sf_dir).withColumn("kind", F.lit("golden"))
    half = F.col("id") % 2
    renamed = records.withColumn("half", half).withColumn("id", F.floor(F.col("id") / 2))
    judged = lambda n: G.judge(renamed.where(F.col("half") == n), COSINE_CUT)
    return G.matched(judged(0), judged(1))


@REGISTRY.query(
    "regression_changes",
    "WITH " + CASES_SQL + JUDGED_SQL
    + """, moved AS (
        SELECT tier, label, answerable, arm, list_contains(old_right, arm) AS was, list_contains("right", arm) AS now
        FROM (SELECT *, unnest(CASE WHEN tier = 'e2e' THEN ['A', 'B', 'D', 'F'] ELSE ['B', 'D', 'F'] END) AS arm FROM pairs)),
      grouped AS (SELECT *, unnest(CASE WHEN label = 'answerable' THEN [label] ELSE [label, 'unanswerable'] END) AS "group" FROM moved WHERE was <> now)
      SELECT tier, "group", arm, count(*) FILTER (was) AS worse, count(*) FILTER (now) AS better,
        count(*) FILTER (was) - count(*) FILTER (now) AS net,
        (abs(count(*) FILTER (was) - count(*) FILTER (now)) >= 3)::INT AS fails
      FROM grouped GROUP BY tier, "group", arm""",
)
def regression_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.changes(_pairs(spark, sf_dir)).withColumn("fails", F.col("fails").cast("int"))


@REGISTRY.query(
    "regression_transitions",
    "WITH " + CASES_SQL + JUDGED_SQL
    + """SELECT old_outcome, outcome, count(*) AS cases, count(*) FILTER (old_right = "right") AS silent
        FROM pairs WHERE outcome <> old_outcome GROUP BY 1, 2""",
)
def regression_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transitions(_pairs(spark, sf_dir))


@REGISTRY.query(
    "regression_verdict",
    "WITH " + CASES_SQL + JUDGED_SQL
    + """, moved AS (
        SELECT tier, label, arm, list_contains(old_right, arm) AS was, list_contains("right", arm) AS now
        FROM (SELECT *, unnest(CASE WHEN tier = 'e2e' THEN ['A', 'B', 'D', 'F'] ELSE ['B', 'D', 'F'] END) AS arm FROM pairs)),
      grouped AS (SELECT *, unnest(CASE WHEN label = 'answerable' THEN [label] ELSE [label, 'unanswerable'] END) AS g FROM moved WHERE was <> now),
      nets AS (SELECT count(*) FILTER (was) - count(*) FILTER (now) AS net FROM grouped GROUP BY tier, g, arm)
      SELECT count(*) FILTER (net >= 3) AS worsened_groups, count(*) FILTER (-net >= 3) AS improved_groups,
        0 AS gone, 0 AS "new", 1 AS same_threshold,
        (count(*) FILTER (abs(net) >= 3) = 0)::INT AS passed FROM nets""",
)
def regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = G.verdict(_pairs(spark, sf_dir), COSINE_CUT, COSINE_CUT)
    return row.withColumn("same_threshold", F.col("same_threshold").cast("int")).withColumn("passed", F.col("passed").cast("int"))


@REGISTRY.query(
    "stage_latency",
    "WITH " + CASES_SQL
    + """, s AS (SELECT unnest(['embed', 'search', 'gate']) AS stage, unnest([value, k::DOUBLE, (id % 97)::DOUBLE]) AS sec FROM cases)
        SELECT stage, count(*) AS n, round(quantile_cont(sec, 0.5), 6) AS p50, round(quantile_cont(sec, 0.95), 6) AS p95 FROM s GROUP BY 1""",
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.stage_latency(cases(spark, sf_dir)))


@REGISTRY.query(
    "cost_by_outcome",
    "WITH " + CASES_SQL
    + """SELECT CASE WHEN answered THEN 'answered' ELSE 'declined after generating' END AS "group", count(*) AS n,
          round(avg(CASE WHEN k % 11 <> 0 THEN k END), 6) AS prompt_tokens,
          round(avg(CASE WHEN k % 13 <> 0 THEN k % 7 END), 6) AS completion_tokens,
          round(avg(CASE WHEN k % 5 <> 0 THEN value ELSE 0 END), 6) AS seconds
        FROM cases WHERE kind = 'golden' AND e2e GROUP BY 1""",
)
def cost_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.cost_by_outcome(A.end_to_end(cases(spark, sf_dir))))


@REGISTRY.query(
    "run_summary",
    "WITH " + CASES_SQL
    + "SELECT count(*) AS cases, count(*) AS generated, round(sum(value + k + id % 97) / count(*), 6) AS seconds_per_case FROM cases",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.run_summary(cases(spark, sf_dir)))


@REGISTRY.query(
    "narrative_rates",
    "WITH " + CASES_SQL
    + """SELECT count(*) AS cases, count(*) FILTER (answered = answerable) AS right_decisions,
          count(*) FILTER (answerable AND answered AND id % 6 <> 0) AS item_judged,
          count(*) FILTER (answerable AND answered AND id % 6 <> 0 AND id % 9 = k % 9) AS item_cited,
          count(*) FILTER (answerable AND id % 6 = 0) AS unsound_splits, count(DISTINCT ticker) AS companies
        FROM cases WHERE kind = 'narrative'""",
)
def narrative_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.narrative_table(cases(spark, sf_dir))


@REGISTRY.query(
    "half_widths",
    "WITH " + CASES_SQL
    + f""", t AS (SELECT CASE WHEN answerable THEN 'answerable' ELSE negative_kind END AS label, count(*) AS n
          FROM cases WHERE kind = 'golden' AND e2e GROUP BY 1),
        p AS (SELECT *, (n // 2)::DOUBLE / n AS p, {Z} * {Z} / n AS z2n FROM t)
        SELECT label, n, round({Z} * sqrt(p * (1 - p) / n + z2n / (4 * n)) / (1 + z2n), 6) AS half_width FROM p""",
)
def half_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(G.half_widths(G.judge(cases(spark, sf_dir), COSINE_CUT)))


CONFIRMATORY_SQL = """
, neg AS (
  SELECT id, fold, ticker, bool_or(answers) FILTER (arm = 'A') AS a, bool_or(answers) FILTER (arm = 'E') AS e,
         bool_or(answers) FILTER (arm = 'F') AS f
  FROM by_arm WHERE e2e AND NOT answerable GROUP BY 1, 2, 3),
base AS (SELECT *, a::INT - f::INT AS h1, e::INT - f::INT AS h2 FROM neg)
"""


@REGISTRY.query(
    "confirmatory_differences",
    "WITH " + CASES_SQL + ARMS_SQL + CONFIRMATORY_SQL
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + """, sums AS (SELECT fold::VARCHAR AS stratum, ticker AS cluster, sum(h1)::DOUBLE AS t1, sum(h2)::DOUBLE AS t2, count(*) AS n FROM base GROUP BY ALL),
      reps AS (SELECT replicate, sum(t1) / sum(n) AS h1, sum(t2) / sum(n) AS h2
               FROM draws JOIN clusters USING (stratum, position) JOIN sums USING (stratum, cluster) GROUP BY 1),
      p AS (SELECT avg(a::INT) AS rate_without_gate, avg(h1) AS h1_difference, avg(h2) AS h2_difference,
              count(*) FILTER (e AND NOT f) AS h2_first_only, count(*) FILTER (NOT e AND f) AS h2_second_only FROM base),
      q AS (SELECT quantile_cont(h1, 0.005) AS h1_low, quantile_cont(h1, 0.995) AS h1_high,
              quantile_cont(h2, 0.005) AS h2_low, quantile_cont(h2, 0.995) AS h2_high FROM reps)
      SELECT round(rate_without_gate, 6) AS rate_without_gate, round(h1_difference, 6) AS h1_difference,
        round(h1_low, 6) AS h1_low, round(h1_high, 6) AS h1_high, round(h2_difference, 6) AS h2_difference,
        round(h2_low, 6) AS h2_low, round(h2_high, 6) AS h2_high, h2_first_only, h2_second_only,
        CASE WHEN h1_low > 0.05 THEN 'above the margin' WHEN rate_without_gate < 0.05 THEN 'not attainable'
             WHEN h1_high < 0.05 THEN 'below the margin' ELSE 'inconclusive at this n' END AS h1_reading,
        (h2_high < 0)::INT AS h2_met FROM p, q""",
)
def confirmatory_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cases(spark, sf_dir)
    # Two rows per score; written once so that every part of the comparison reads the same table.
    thresholds = materialize(A.fit_thresholds(records), "thresholds")
    masked = A.with_masks(A.end_to_end(records), thresholds)
    row = A.confirmatory(masked, resamples=RESAMPLES)
    return _rounded(
        row.select(
            "rate_without_gate", "h1_difference", "h1_low", "h1_high", "h2_difference", "h2_low", "h2_high",
            "h2_first_only", "h2_second_only", "h1_reading", F.col("h2_met").cast("int").alias("h2_met"),
        )
    )


@REGISTRY.query(
    "clustered_rates",
    "WITH " + CASES_SQL + ARMS_SQL
    + ", base AS (SELECT fold, ticker, arm, answers FROM by_arm WHERE e2e AND NOT answerable)"
    + DRAWS_SQL.format(seed=S.REPORT_SEED, resamples=RESAMPLES)
    + """, sums AS (SELECT ticker AS cluster, arm, sum(answers::INT)::DOUBLE AS total, count(*) AS n FROM base GROUP BY ALL),
      reps AS (SELECT arm, replicate, sum(total) / sum(n) AS v FROM draws JOIN clusters USING (stratum, position) JOIN sums USING (cluster) GROUP BY 1, 2)
      SELECT arm, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM reps GROUP BY arm""",
)
def clustered_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.clustered_rates(_by_arm(spark, sf_dir), "fold", RESAMPLES))


@REGISTRY.query(
    "first_by_hash",
    "SELECT event_id AS id, user_id FROM events ORDER BY sha256(event_id::VARCHAR) LIMIT 30",
)
def first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.first_by_hash(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id"), 30)

"""Ranking, thresholds, bootstrap and running totals against NumPy brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.functions import statistics as ST
from proofline.operators import bootstrap as B
from proofline.operators import ranking as R
from proofline.operators import running as RT


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # A third of all rows share one score and one cluster.
    score = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.random(n), 2))
    label = rng.random(n) < 0.3 + 0.4 * score
    cluster = np.where(rng.random(n) < 0.34, 0, rng.integers(0, 25, n))
    fold = cluster % 2
    rows = list(zip(score.tolist(), label.tolist(), cluster.tolist(), fold.tolist()))
    return spark.createDataFrame(rows, "score DOUBLE, label BOOLEAN, cluster INT, fold INT").cache(), score, label, cluster, fold


def pair_count(score, label):
    pos, neg = score[label][:, None], score[~label][None, :]
    return float((pos > neg).mean() + 0.5 * (pos == neg).mean())


def test_auroc_equals_counting_pairs(scored):
    df, score, label, _, fold = scored
    assert math.isclose(R.auroc(df, "score", "label").first().auroc, pair_count(score, label), rel_tol=1e-12)
    for row in R.auroc(df, "score", "label", ["fold"]).collect():
        assert math.isclose(row.auroc, pair_count(score[fold == row.fold], label[fold == row.fold]), rel_tol=1e-12)
    assert R.auroc(df.where("label"), "score", "label").first().auroc is None


def test_running_totals_do_not_depend_on_buckets(scored):
    df, score, *_ = scored
    counts = df.groupBy("score").agg(F.count("*").alias("n"))
    for buckets in (1, 3, 50):
        for descending in (False, True):
            got = {r.score: r.n_through for r in RT.running_totals(counts, "score", ["n"], descending=descending, buckets=buckets).collect()}
            for value in np.unique(score):
                assert got[value] == int((score >= value).sum() if descending else (score <= value).sum())


def test_thresholds(scored, spark):
    df, score, label, _, fold = scored
    got = {r.fold: r.threshold for r in R.crossfit_thresholds(df, "score", "label", "fold").collect()}
    for f in (0, 1):
        positives = np.sort(score[label & (fold != f)])[::-1]
        assert got[f] == positives[math.ceil(0.9 * positives.size - 1e-9) - 1]
    # 0.07 * 100 is a little above seven in doubles.
    hundred = spark.range(1, 101).select(F.col("id").cast("double").alias("s"))
    assert R.threshold_at_recall(hundred, "s", 0.07).first().threshold == 94
    point = R.operating_point(df, "score", "label", "fold").first()
    cut = np.where(fold == 0, got[0], got[1])
    assert math.isclose(point.recall, float((score >= cut)[label].mean()))
    assert math.isclose(point.false_accept_rate, float((score >= cut)[~label].mean()))


def test_risk_and_coverage(scored):
    df, score, label, *_ = scored
    curve = R.risk_coverage_curve(df, "score", "label")
    area, points = 0.0, []
    for value in np.unique(score)[::-1]:
        taken = score >= value
        points.append((taken.mean(), (~label[taken]).mean()))
    before = 0.0
    for coverage, risk in points:
        area, before = area + (coverage - before) * risk, coverage
    assert math.isclose(R.risk_coverage_area(curve).first().area, area, rel_tol=1e-9)
    for row in R.risk_at_coverage(curve, (0.25, 1.0)).collect():
        coverage, risk = next(p for p in points if p[0] >= row.target)
        assert math.isclose(row.coverage, coverage) and math.isclose(row.risk, risk)


def drawn_clusters(df, resamples, seed=7):
    """The draws the operator makes, as lists of clusters per replicate."""
    clusters = B.numbered_clusters(df.select(F.col("fold").cast("string").alias("stratum"), "cluster").distinct()).collect()
    out = {r: [] for r in range(resamples)}
    for stratum in {c.stratum for c in clusters}:
        own = sorted((c.position, c.cluster) for c in clusters if c.stratum == stratum)
        for leaf in range(-(-len(own) // B.LEAF)):
            weights = B.leaf_weights(seed, range(resamples), stratum, len(own), leaf)
            for replicate, row in enumerate(weights):
                for (_, cluster), times in zip(own[leaf * B.LEAF :], row):
                    out[replicate] += [cluster] * int(times)
    return out


MEAN = B.UserAggregate(
    lambda rows, weights: weights @ rows[["t", "n"]].to_numpy(), lambda state: state[0] / state[1]
)


def test_a_draw_hits_every_cluster_alike_in_one_leaf_or_many(monkeypatch):
    monkeypatch.setattr(B, "LEAF", 7)
    size, replicates = 40, range(300)
    whole = np.concatenate([B.leaf_weights(3, replicates, "s", size, leaf) for leaf in range(6)], axis=1)
    assert (whole.sum(axis=1) == size).all() and whole.shape == (300, size)
    # Each cluster's weights have mean 1 and variance 1 - 1/size; those of two add up less freely.
    assert abs(whole.mean(axis=0) - 1).max() < 0.25
    assert abs(whole.var(axis=0).mean() - (1 - 1 / size)) < 0.06
    halves = whole[:, :20].sum(axis=1)
    assert abs(halves.mean() - 20) < 0.7 and abs(halves.var() - 10) < 2.5
    again = B.leaf_weights(3, range(100, 200), "s", size, 4)
    assert (again == whole[100:200, 28:35]).all()


@pytest.mark.parametrize("leaf", [4096, 5])
def test_replicates_equal_resampling_rows(scored, monkeypatch, leaf):
    monkeypatch.setattr(B, "LEAF", leaf)
    df, score, label, cluster, _ = scored
    draws = drawn_clusters(df, 20)
    means = {r.replicate: r.value for r in B.mean_replicates(df, "score", "cluster", "fold", 20, 7).collect()}
    areas = {r.replicate: r.value for r in B.auroc_replicates(df, "score", "label", "cluster", "fold", 20, 7).collect()}
    sums = df.groupBy("fold", "cluster").agg(F.sum("score").alias("t"), F.count("*").alias("n"))
    generic = {
        r.replicate: r.value
        for r in B.cluster_bootstrap(sums, MEAN, "cluster", "fold", 20, 7).collect()
    }
    assert len(draws) == 20 and all(len(d) == len(set(cluster)) for d in draws.values())
    for replicate, clusters in draws.items():
        rows = np.concatenate([np.flatnonzero(cluster == c) for c in clusters])
        assert math.isclose(means[replicate], score[rows].mean(), rel_tol=1e-9)
        assert math.isclose(generic[replicate], score[rows].mean(), rel_tol=1e-9)
        assert math.isclose(areas[replicate], pair_count(score[rows], label[rows]), rel_tol=1e-9)


@pytest.mark.parametrize("opening", [b"7:12:0/3:", b"a" * 50, b"a" * 52, b"a" * 70])
def test_hashes_of_draws_are_md5(opening):
    for count in (0, 1, 10, 11, 1234):
        both = [int.from_bytes(hashlib.md5(o + str(i).encode()).digest()[:4], "big") for o, n in ((opening, count), (opening[::-1], 3)) for i in range(n)]
        assert B._md5_heads([opening, opening[::-1]], [count, 3]).tolist() == both


def test_a_replicate_costs_a_cluster_one_byte_and_ties_go_across_slices(scored, monkeypatch):
    kept = {}

    def keep(df, purpose, materialize=B.materialize):
        kept[purpose] = materialize(df, purpose)
        return kept[purpose]

    df, score, label, cluster, _ = scored
    whole = {r.replicate: r.value for r in B.auroc_replicates(df, "score", "label", "cluster", "fold", 120, 7).collect()}
    monkeypatch.setattr(B, "materialize", keep)
    monkeypatch.setattr(B, "SLICE_ROWS", 2)
    monkeypatch.setattr(B, "BUCKET_ROWS", 40)
    areas = {r.replicate: r.value for r in B.auroc_replicates(df, "score", "label", "cluster", "fold", 120, 7).collect()}
    assert len(areas) == 120 and all(math.isclose(areas[r], whole[r], rel_tol=1e-12) for r in whole)
    weights = kept["weights"].groupBy("stratum", "cluster").agg(F.sum(F.octet_length("weights")).alias("bytes")).collect()
    assert len(weights) == len(set(cluster)) and all(row.bytes == 120 for row in weights)
    assert kept["bucketed-histograms"].select("_bucket").distinct().count() > 1


def test_strata_keep_their_size_and_undefined_replicates_are_counted(scored, spark):
    df, *_ = scored
    draws = drawn_clusters(df, 5)
    assert all(sum(c % 2 == 0 for c in d) == 13 for d in draws.values())
    broken = spark.createDataFrame([(float(i),) for i in range(90)] + [(None,)] * 10, "value DOUBLE")
    row = B.interval(broken).first()
    assert row.undefined == 10 and row.low is None
    assert B.split_clusters(spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "c INT, s INT"), "c", "s").count() == 1


def test_wilson_values(spark):
    # Published intervals (Newcombe 1998 and the usual edge cases).
    rows = [(81, 263, 0.2553, 0.3662), (15, 148, 0.0624, 0.1605), (0, 20, 0.0, 0.1611), (1, 29, 0.0061, 0.1718)]
    df = spark.createDataFrame([(k, n) for k, n, *_ in rows], "k INT, n INT")
    got = df.select("k", ST.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    for (k, n, low, high), row in zip(rows, got):
        assert abs(row.w.low - low) < 6e-5 and abs(row.w.high - high) < 6e-5
    assert spark.sql("SELECT 0 AS k, 0 AS n").select(ST.wilson(F.col("k"), F.col("n")).alias("w")).first().w is None


def test_mcnemar_values(spark):
    rows = [(0, 0, 1.0), (2, 0, 0.5), (10, 0, 2 / 1024), (5, 5, 1.0), (0, 6, 2 / 64), (1, 7, 18 / 256)]
    df = spark.createDataFrame([(b, c, p) for b, c, p in rows], "b INT, c INT, p DOUBLE")
    assert all(math.isclose(r.p, r.v) for r in df.select("p", ST.mcnemar_exact("b", "c").alias("v")).collect())
    big = spark.sql("SELECT 600 AS b, 500 AS c").select(ST.mcnemar_exact("b", "c").alias("v")).first().v
    exact = min(1.0, 2 * sum(math.comb(1100, i) for i in range(501)) / 2**1100)
    assert math.isclose(big, exact, rel_tol=1e-9)


def test_closed_forms(spark):
    row = spark.range(1).select(
        ST.hanley_mcneil_se(F.lit(0.8), F.lit(100), F.lit(100)).alias("se"),
        ST.margin_reading(F.lit(0.06), F.lit(0.1), F.lit(0.2)).alias("a"),
        ST.margin_reading(F.lit(0.0), F.lit(0.1), F.lit(0.02)).alias("b"),
        ST.margin_reading(F.lit(0.0), F.lit(0.01), F.lit(0.2)).alias("c"),
        ST.margin_reading(F.lit(0.0), F.lit(0.1), F.lit(0.2)).alias("d"),
    ).first()
    assert abs(row.se - 0.0318) < 5e-4
    assert [row.a, row.b, row.c, row.d] == ["above the margin", "not attainable", "below the margin", "inconclusive at this n"]


def test_leaves_are_dealt_over_all_tasks(scored):
    # A few kilobytes here; by their size alone adaptive execution would give them to one task.
    df, *_ = scored
    clusters = df.select(F.col("fold").cast("string").alias("stratum"), "cluster").distinct()
    leaves = B._leaves(clusters, 5000)
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert leaves.rdd.getNumPartitions() == tasks

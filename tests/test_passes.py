"""AUROC replicates in passes over their ranges."""

import os

from proofline.operators import bootstrap as B
from pyspark.sql import functions as F


def test_passes_hold_every_range_once(monkeypatch):
    monkeypatch.setattr(B, "PASS_BYTES", 100)
    for used in (1, 2, 15, 16):
        for moved in (0, 1, 7, 30, 100, 101, 10**9):
            found = B._passes(used, moved)
            assert [r for p in found for r in p] == list(range(used))
            assert all(len(p) == 1 or len(p) * moved <= 100 for p in found)


def test_passes_give_what_one_gives_and_leave_no_weights(spark, monkeypatch):
    rows = spark.range(400).select(
        F.expr("id % 37").alias("cluster"), F.expr("id % 37 % 2").alias("fold"), F.expr("id * 7919 % 61 / 4").alias("score"), F.expr("id % 3 = 0").alias("label")
    )
    whole = {r.replicate: r.value for r in B.auroc_replicates(rows, "score", "label", "cluster", "fold", 250, 7).collect()}
    paths = []

    def keep(df, purpose, materialize=B.materialize):
        table = materialize(df, purpose)
        paths.extend(table.inputFiles()[:1] if purpose == "weights" else [])
        return table

    monkeypatch.setattr(B, "PASS_BYTES", 1)
    monkeypatch.setattr(B, "materialize", keep)
    found = B.auroc_replicates(rows, "score", "label", "cluster", "fold", 250, 7)
    assert {r.replicate: r.value for r in found.collect()} == whole and len(whole) == 250
    assert len(paths) == 3 and not any(os.path.exists(p.removeprefix("file:").replace("///", "/")) for p in paths)


def test_a_difference_has_the_same_draws_on_both_sides_in_passes(spark, monkeypatch):
    monkeypatch.setattr(B, "PASS_BYTES", 1)
    rows = spark.range(300).select(
        F.expr("id % 23").alias("cluster"), F.expr("id % 23 % 2").alias("fold"), F.expr("id * 7919 % 61 / 4").alias("score"), F.expr("id % 3 = 0").alias("label")
    )
    both = rows.withColumn("doubled", F.col("score") * 2)
    first, second = (B.auroc_replicates(both, score, "label", "cluster", "fold", 150, 7) for score in ("score", "doubled"))
    found = B.auroc_difference_replicates(first, second).collect()
    assert len({r.replicate for r in found}) == 150 and {r.value for r in found} == {0.0}
    # The tables of a pass are gone, the results of all passes are there.
    assert first.count() == 150 and second.count() == 150

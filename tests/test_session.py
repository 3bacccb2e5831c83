import os

from proofline.session import materialize, temporary


def test_temporary_tables_go_and_kept_ones_stay(spark):
    rows = spark.range(5)
    with temporary(spark) as keep:
        inner = materialize(rows, "inner")
        with temporary(spark) as keep_more:
            lost = materialize(rows, "lost")
            passed = keep_more(lost.where("id > 1"), "passed")
        assert passed.count() == 3
        gone = [lost.inputFiles()[0]]
        kept = keep(inner.join(passed, "id"), "kept")
        gone += [t.inputFiles()[0] for t in (inner, passed)]
    outside = materialize(rows, "outside")
    assert not any(os.path.exists(path.removeprefix("file:").replace("///", "/")) for path in gone)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert outside.count() == 5

"""The index store: replacement by filing, versions, writes cut off, files."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators import retrieval as R
from proofline.sources import store as ST


def _passages(spark, filings, each, mark):
    rows = [(f, f"{f}:{i}", i, [float(i), 1.0], mark) for f in filings for i in range(each)]
    return spark.createDataFrame(rows, "accession STRING, chunk_id STRING, ordinal INT, vector ARRAY<FLOAT>, mark STRING")


def _named(spark, filings):
    return spark.createDataFrame([(f,) for f in filings], "accession STRING")


def _held(chunks):
    return {(r.accession, r.mark): r.n for r in chunks.groupBy("accession", "mark").agg(F.count("*").alias("n")).collect()}


def test_a_filing_is_replaced_and_old_versions_stay(spark, tmp_path):
    path = str(tmp_path / "index")
    assert ST.newest_version(spark, path) == 0
    with pytest.raises(ValueError):
        ST.read_chunks(spark, path)
    every = [f"f{i}" for i in range(60)]
    assert ST.write_filings(_passages(spark, every, 3, "a"), _named(spark, every), path, buckets=4) == 1
    # Of the passages given, only those of the named filings are written; f9 has none left.
    assert ST.write_filings(_passages(spark, ["f1", "f2", "f3"], 5, "b"), _named(spark, ["f1", "f2", "f9"]), path) == 2
    assert _held(ST.read_chunks(spark, path, 1)) == {(f, "a"): 3 for f in every}
    now = {(f, "a"): 3 for f in every if f not in ("f1", "f2", "f9")} | {("f1", "b"): 5, ("f2", "b"): 5}
    assert _held(ST.read_chunks(spark, path)) == now
    listed = {r.accession: r.chunks for r in ST.read_filings(spark, path).collect()}
    assert listed == {f: n for (f, _), n in now.items()}
    assert _held(ST.read_chunks(spark, path, asked=_named(spark, ["f2", "f9", "f5", "x"]))) == {("f2", "b"): 5, ("f5", "a"): 3}
    with pytest.raises(ValueError):
        ST.read_chunks(spark, path, 3)
    assert ST.write_filings(_passages(spark, [], 1, "c"), _named(spark, []), path) == 2
    # Digests of filings that stayed are those of the first version.
    first = {r.accession: r.digest for r in ST.read_filings(spark, path, 1).collect()}
    last = {r.accession: r.digest for r in ST.read_filings(spark, path, 2).collect()}
    assert {f for f in last if last[f] == first[f]} == set(last) - {"f1", "f2"}


def test_files_number_buckets_not_filings(spark, tmp_path):
    for count in (20, 200):
        path = str(tmp_path / f"index{count}")
        every = [f"f{i}" for i in range(count)]
        ST.write_filings(_passages(spark, every, 2, "a"), _named(spark, every), path, buckets=4)
        assert len(glob.glob(f"{path}/chunks/**/*.parquet", recursive=True)) == 4
        assert len(glob.glob(f"{path}/filings/**/*.parquet", recursive=True)) == 4
        assert len(glob.glob(f"{path}/log/**/*.parquet", recursive=True)) == 1


def test_a_large_filing_is_written_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BLOCK_ROWS", 10)
    path = str(tmp_path / "index")
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # would join blocks this small
    spark.conf.set(joined, "false")
    try:
        ST.write_filings(_passages(spark, ["f"], 100, "a"), _named(spark, ["f"]), path, buckets=4)
    finally:
        spark.conf.unset(joined)
    assert _held(ST.read_chunks(spark, path)) == {("f", "a"): 100}
    files = glob.glob(f"{path}/chunks/**/*.parquet", recursive=True)
    assert max(spark.read.parquet(f).count() for f in files) < 100


def test_a_write_cut_off_is_not_seen_and_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    ST.write_filings(_passages(spark, ["f", "g"], 2, "a"), _named(spark, ["f", "g"]), path, buckets=2)

    class Lost(Exception):
        pass

    def lose(chunks):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(ST.IX, "filing_digests", lose)
        with pytest.raises(Lost):
            ST.write_filings(_passages(spark, ["f"], 7, "b"), _named(spark, ["f"]), path)
    assert _held(ST.read_chunks(spark, path)) == {("f", "a"): 2, ("g", "a"): 2}

    real = ST.IX.filing_digests

    def overtaken(chunks):
        m.undo()
        ST.write_filings(_passages(spark, ["g"], 4, "c"), _named(spark, ["g"]), path)
        return real(chunks)

    with monkeypatch.context() as m:
        m.setattr(ST.IX, "filing_digests", overtaken)
        with pytest.raises(Exception, match="already exists"):
            ST.write_filings(_passages(spark, ["f"], 7, "b"), _named(spark, ["f"]), path)
    assert _held(ST.read_chunks(spark, path)) == {("f", "a"): 2, ("g", "c"): 4}


def _vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(f"f{i % 3 if i % 2 else 0}", f"c{i}", i, [float(x) for x in draw.normal(size=4)]) for i in range(1500)]
    return spark.createDataFrame(rows, "accession STRING, chunk_id STRING, ordinal INT, vector ARRAY<FLOAT>")


def test_stored_blocks_answer_like_passages_and_do_not_move(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = _vectors(spark)
    ST.write_filings(chunks, chunks.select("accession").distinct(), path, buckets=4)
    asked = chunks.where("ordinal % 7 = 0").select(F.col("ordinal").alias("question_id"), "accession", "vector")
    asked = asked.unionByName(spark.createDataFrame([(-1, "none", [1.0] * 4)], asked.schema))
    wanted = sorted(R.scoped_topk(asked, chunks, 3).collect())
    assert len(wanted) == 3 * asked.where("question_id >= 0").count()
    blocks = ST.read_blocks(spark, path, asked=asked)
    for most in (R.MOST_BROADCAST, 0):
        assert sorted(R.blocks_topk(asked, blocks, 3, most).collect()) == wanted
    # From the scan of the stored blocks to the products there is a join that moves only questions.
    plan = R.blocks_topk(asked, blocks, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "BroadcastHashJoin" in below and "hashpartitioning" not in below
    assert R.blocks_topk(asked.where("question_id < 0"), blocks, 3).count() == 0

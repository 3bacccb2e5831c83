"""Smaller operators that no query or job test reaches."""

from pyspark.sql import functions as F

from proofline.functions import statistics as ST
from proofline.operators import quality as Q
from proofline.operators import questions as QS
from proofline.operators import retrieval as R
from proofline.sources import readers as RD
from proofline.streaming import jobs as J


def test_smallest_effect_with_enough_power(spark):
    df = spark.createDataFrame([(0.5, -0.01), (0.82, -0.03), (0.95, 0.05)], "power DOUBLE, effect DOUBLE")
    row = df.agg(ST.minimum_detectable(F.col("power"), F.col("effect")).alias("m"), ST.minimum_detectable(F.col("power"), F.col("effect"), 0.99).alias("n")).first()
    assert (row.m, row.n) == (0.03, None)


def test_narratives_are_held_to_their_filing(spark):
    filings = spark.createDataFrame([("T", 1, 2024, "a")], "ticker STRING, cik BIGINT, fiscal_year INT, accession STRING")
    sections = spark.createDataFrame([("a", "Item 1", "We sell phones."), ("a", "Item 1", "And services.")], "accession STRING, item STRING, text STRING")
    words = spark.createDataFrame([("a", " we sell phones and services ")], "accession STRING, words STRING")
    rows = [
        ("good", "T", 1, 2024, "a", True, "Item 1", ["phones", "services"], []),
        ("term", "T", 1, 2024, "a", True, "Item 1", ["phones", "boats"], []),
        ("item", "T", 1, 2024, "a", True, "Item 9", ["phones"], []),
        ("said", "T", 1, 2024, "a", False, None, [], ["sell phones", "boats"]),
        ("other", "T", 2, 2024, "a", True, "Item 1", ["phones"], []),
        ("gone", "U", 1, 2024, "a", True, "Item 1", ["phones"], []),
    ]
    cases = spark.createDataFrame(
        rows, "id STRING, ticker STRING, cik BIGINT, fiscal_year INT, accession STRING, answerable BOOLEAN, expected_item STRING, evidence_terms ARRAY<STRING>, absent_terms ARRAY<STRING>"
    )
    got = {(r.id, r.problem) for r in QS.narrative_problems(cases, filings, sections, words).collect()}
    assert got == {
        ("term", "'boats' is not in Item 1"), ("item", "no section Item 9"), ("said", "'sell phones' occurs in the filing"),
        ("other", "accession or CIK differs from the lock"), ("gone", "no pinned filing"),
    }
    checked = Q.narrative_rules(cases.withColumn("question", F.lit("What?"))).where(F.size("violations") > 0)
    assert checked.count() == 0


def test_records_are_appended_once_per_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    rows.write.parquet(source)
    stream = J.file_stream(spark, source, "*.parquet", rows)
    path = str(tmp_path / "out")
    J.append_records(stream, path).awaitTermination()
    rows.write.mode("append").parquet(source)
    J.append_records(stream, path).awaitTermination()
    assert J.written(spark, path, rows).count() == 20


def test_a_rebuilt_model_is_seen(spark):
    made = spark.createDataFrame([("m", "d1"), ("n", "d2")], "name STRING, digest STRING")
    now = spark.createDataFrame([("m", "d1"), ("n", "d3")], "name STRING, digest STRING")
    assert [r.name for r in R.rebuilt_models(made, now).collect()] == ["n"]


def test_a_run_with_a_broken_line_is_incomplete(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "kind": "golden"}\nnot json\n')
    (tmp_path / "determinism.jsonl").write_text('{"id": "a", "identical": true}\n{"id": \n')
    (tmp_path / "manifest.json").write_text('{"cases": 2}')
    cases, repeats, manifest, bad = RD.read_run(spark, str(tmp_path))
    assert [r.id for r in cases.collect()] == ["a"] and repeats.count() == 1
    assert bad.count() == 2
    assert RD.incomplete_run(cases, manifest).count() == 1


def test_recorded_calls_without_a_key_are_handed_back(spark, tmp_path):
    (tmp_path / "calls.jsonl").write_text('{"key": "k", "request": "{}", "response": "{}"}\nnot json\n{"request": "{}"}\n')
    calls, bad = RD.read_recording(spark, str(tmp_path / "calls.jsonl"), "embed")
    assert [(r.kind, r.key) for r in calls.collect()] == [("embed", "k")] and bad.count() == 2


def test_listings_with_unreadable_dates_are_refused(spark):
    def listing(filed, reported, first="2020-01-01"):
        recent = f'{{"form": ["10-K"], "accessionNumber": ["0000000042-24-000001"], "primaryDocument": ["a.htm"], "filingDate": ["{filed}"], "reportDate": ["{reported}"]}}'
        return f'{{"cik": "42", "name": "n", "filings": {{"recent": {recent}, "files": [{{"name": "p", "filingFrom": "{first}", "filingTo": "2021-01-01"}}]}}}}'

    rows = [(1, listing("2024-02-01", "")), (2, listing("soon", "2023-12-31")), (3, listing("2024-02-01", "never")), (4, listing("2024-02-01", "2023-12-31", "then"))]
    filings, _, bad = RD.parse_submissions(spark.createDataFrame(rows, "cik BIGINT, text STRING"))
    assert [r.cik for r in filings.collect()] == [1]
    assert sorted((r.cik, tuple(r.violations)) for r in bad.collect()) == [(2, ("dates",)), (3, ("dates",)), (4, ("dates",))]


def test_vector_blocks_are_dealt_by_block(spark):
    rows = spark.range(4000).selectExpr("1 AS g", "id", "array(1.0D, cast(id AS double)) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = R.vector_blocks(rows, "g", "id", "v", "id", 100)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        exchange = next(line for line in plan.splitlines() if "REPARTITION_BY_COL" in line)
        assert "block" in exchange
        assert blocks.count() >= 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_streamed_table_may_be_a_file_or_a_folder_of_parts(spark, tmp_path):
    rows = spark.range(20).withColumn("x", F.col("id") * 2)
    rows.repartition(3).write.parquet(f"{tmp_path}/in/parts.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "in" / "file.parquet").write_bytes(next((tmp_path / "one").glob("part-*.parquet")).read_bytes())
    for name in ("parts.parquet", "file.parquet"):
        path = f"{tmp_path}/out-{name}"
        J.start(J.file_stream(spark, f"{tmp_path}/in", name, rows), J.append, path).awaitTermination()
        assert sorted(r.x for r in J.written(spark, path, rows).collect()) == list(range(0, 40, 2))
    assert J.written(spark, f"{tmp_path}/never", rows).count() == 0

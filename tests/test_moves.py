"""What large joins move: each row once, and no copies of it."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofline.operators import facts as FA


@pytest.fixture
def shuffled(spark):
    """Joins as large tables have them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_wanted_row_moves_once(spark, shuffled):
    day = lambda text: F.to_date(F.lit(text))
    rows = [(1, "g", "A", "O", Decimal(k), 10 * k) for k in (5, 7)]
    facts = spark.createDataFrame(rows, "cik INT, taxonomy STRING, concept STRING, unit STRING, value DECIMAL(38,9), ordinal BIGINT")
    facts = facts.select(
        "*", F.lit(None).cast("date").alias("start"), F.date_add(day("2024-01-01"), F.col("ordinal").cast("int")).alias("end"), F.lit("f").alias("accession")
    )
    # Period ends: 20 February and 11 March. Each target lies within seven days of one, of both, or of none.
    asked = [("f", "A", "2024-02-14"), ("f", "A", "2024-03-18"), ("f", "A", "2024-03-01"), ("f", None, "2024-02-20"), (None, "A", "2024-02-20"), ("f", "A", None), ("f", "A", "2024-02-14")]
    wanted = spark.createDataFrame(asked, "accession STRING, concept STRING, report_date STRING").select(
        "accession", F.lit("g").alias("taxonomy"), "concept", F.lit("O").alias("unit"), F.to_date("report_date").alias("report_date"), F.lit(0).alias("years_before")
    )
    found = FA.reported_facts(wanted, facts)
    plan = _plan(found)
    assert "explode" not in plan and plan.count("Exchange hashpartitioning") == 3
    got = {(r.accession, r.concept, str(r.report_date)): (r.matches, r.conflict, r.fact and int(r.fact.value)) for r in found.collect()}
    none = (0, False, None)
    # A row that is asked for twice is one row whose matches count twice.
    assert got == {
        ("f", "A", "2024-02-14"): (2, False, 5), ("f", "A", "2024-03-18"): (1, False, 7), ("f", "A", "2024-03-01"): none,
        ("f", None, "2024-02-20"): none, (None, "A", "2024-02-20"): none, ("f", "A", "None"): none,
    }


def test_lines_of_a_document_move_once(spark, shuffled, tmp_path):
    from proofline.catalog import sources

    line = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_returnflag STRING, l_linestatus STRING, l_extendedprice DOUBLE, l_shipdate DATE"
    rows = [(k // 4, k % 4, 10 + k, 5, "AR"[k % 2], "FO"[k // 2 % 2], 100.5 + k, None) for k in range(12)]
    made = spark.createDataFrame(rows, line).withColumn("l_shipdate", F.to_date(F.lit("1997-03-04")))
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    documents = sources._company_facts(spark, str(tmp_path))
    assert _plan(documents).count("Exchange") == 1
    assert documents.count() == 3
    facts = sources.fact_json_explode(spark, str(tmp_path)).collect()
    assert sorted((r.cik, r.concept, r.unit, r.cents) for r in facts) == sorted((k // 4, "AR"[k % 2], "FO"[k // 2 % 2], 10050 + 100 * k) for k in range(4, 12))
    assert [tuple(r) for r in sources.fact_json_quarantine(spark, str(tmp_path)).collect()] == [(0, "numbers")]


def test_most_targets_lie_in_one_bucket(spark):
    days = spark.range(15 * FA.BUCKET_DAYS).select(F.date_add(F.to_date(F.lit("2000-01-01")), F.col("id").cast("int")).alias("day"))
    buckets = days.select(F.explode(FA._near_buckets(F.col("day"))))
    assert buckets.count() < 1.2 * days.count()


def test_values_at_the_edge_of_a_bucket(spark):
    """Every distance of a target to a period end, over more than a bucket: seven days are near."""
    day = lambda n: F.date_add(F.to_date(F.lit("2003-01-01")), n.cast("int"))
    ends = spark.range(0, 3 * FA.BUCKET_DAYS, 9).select(
        F.lit(1).alias("cik"), F.lit("us-gaap").alias("taxonomy"), F.lit("A").alias("concept"), F.lit("O").alias("unit"),
        F.col("id").cast("decimal(38,9)").alias("value"), F.lit(None).cast("date").alias("start"), day(F.col("id")).alias("end"),
    )
    wanted = spark.range(3 * FA.BUCKET_DAYS).select(
        F.col("id").alias("accession"), F.lit(1).alias("cik"), F.lit("O").alias("unit"), F.array(F.lit("A")).alias("tags"),
        day(F.col("id")).alias("report_date"), F.lit(0).alias("years_before"),
    )
    got = sorted((r.accession, int(r.value)) for r in FA.values_for_period(wanted, ends.unionByName(ends)).collect())
    assert got == [(t, e) for t in range(3 * FA.BUCKET_DAYS) for e in range(0, 3 * FA.BUCKET_DAYS, 9) if abs(t - e) <= 7]


def test_texts_of_printed_numbers_are_parsed_once(spark, tmp_path):
    import re

    from proofline.catalog import numbers

    line = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE"
    spark.createDataFrame([(1, k, 3, 4, 5.0, 12345.67 + k, 0.1) for k in range(4)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = numbers.printed_lookup(spark, str(tmp_path))
    # The values are read where they are asked about and where they are given back, the texts no more.
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", _plan(found))) == 2
    assert found.count() == 4

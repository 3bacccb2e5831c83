import datetime

from proofline.operators import facts as FA

FACT = "cik INT, accession STRING, fiscal_year INT, form STRING, ordinal LONG, filed DATE"


def test_labels_and_first_dates_in_one_pass(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [
        (1, "a", 2023, "10-K", 5, day(9)), (1, "a", 2023, "10-K", 6, day(8)), (1, "a", 2022, "10-K", 1, day(7)),
        # Another company's rows under the accession, one of another form and the first date.
        (2, "a", 2021, "10-K", 7, None), (3, "a", 2020, "10-Q", 8, day(2)),
        # Even counts: the year met first. Only other forms, or no year: no label.
        (1, "b", 2020, "10-K", 4, day(5)), (1, "b", 2021, "10-K", 3, day(6)), (1, "c", 2020, "10-Q", 1, day(1)),
        (1, "d", None, "10-K", 1, day(1)), (1, "d", 2019, None, 2, day(1)), (1, None, 2020, "10-K", 1, day(1)), (None, "e", 2018, "10-K", None, None),
    ]
    spark.createDataFrame(rows, FACT).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    found = FA.labelled_filings(facts)
    apart = FA.fiscal_labels(facts).join(FA.first_filed(facts), "accession").select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    assert found.count() == 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_the_facts_of_a_query_are_joined_once(spark, tmp_path):
    from proofline.catalog import facts as catalog

    line = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_shipdate DATE, l_returnflag STRING, l_linestatus STRING, l_extendedprice DOUBLE"
    spark.createDataFrame([(1, 1, 2, 3, 4.0, datetime.date(1997, 3, 4), "A", "O", 5.0)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, datetime.date(1997, 1, 2))], "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.fiscal_label_mode(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert [tuple(r) for r in found.collect()] == [(7, 1, 1998, "1997-03-04")]

from decimal import Decimal

from pyspark.sql import functions as F

from proofline.catalog import numbers
from proofline.operators import answering as AN

LINE = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_compared_with_two_values_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 4, 5.0, 12345.67, 0.1), (1, 3, 3, 4, 5.0, 900000.0, 0.1)], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = numbers.amounts_scaled_match(spark, str(tmp_path))
    assert _plan(found).count("regexp_extract_all") == 1
    assert sorted((r.l_linenumber, r.own, r.other) for r in found.collect()) == [(2, 1, 0), (3, 1, 1)]


def test_passages_are_read_once_for_both_checks(spark):
    rows = [
        (1, "It was $1,234.56 [1].", False, [1]), (2, "It was $1,234.56 [2].", False, [2]), (3, "It was $9 [1].", False, []),
        (4, None, True, None), (5, "It was $1,234.56.", False, None),
    ]
    made = spark.createDataFrame(rows, "id int, answer string, abstained boolean, cited array<int>")
    answers = made.select(
        "id", "answer", "abstained",
        F.transform("cited", lambda n: F.struct(n.alias("marker"), F.concat(F.lit("Item "), n.cast("string")).alias("item"))).alias("citations"),
        F.array(F.struct(F.lit("Paid 1,234.56 then").alias("text")), F.struct(F.lit("Paid by truck").alias("text"))).alias("passages"),
        F.lit(Decimal("1234.56")).cast("decimal(38,9)").alias("expected_value"), F.lit("0.005").cast("decimal(10,6)").alias("tolerance"),
        F.lit(False).alias("per_share"),
    )
    graded = AN.graded(answers)
    # Once for the answer and once for its passages.
    assert _plan(graded).count("regexp_extract_all") == 2
    got = {r.id: (r.numeric_correct, r.citation_supported, r.gold_retrieved, r.cited_items) for r in graded.collect()}
    assert got == {
        1: (True, True, True, ["Item 1"]), 2: (True, False, True, ["Item 2"]), 3: (False, False, True, []),
        4: (None, None, None, []), 5: (True, False, True, []),
    }

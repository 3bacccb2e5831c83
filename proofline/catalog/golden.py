"""Labelled questions generated from orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline import schemas as S
from proofline.catalog.compare import REGISTRY
from proofline.catalog.tables import FILINGS_SQL, cents, money_text, spread_table, table
from proofline.operators import printed as PR
from proofline.operators import questions as Q
from proofline.plans import questions as PQ
from proofline.session import materialize

# --- fixed values: concepts of the rendered filings -----------------------------------------------
CONCEPT_ROWS = [
    ("a_or_r", ["A", "R"], "O", ["What was {company}'s first figure in fiscal {year}?", "State the first figure of {company} for {year}."]),
    ("n", ["N"], "O", ["What was {company}'s second figure in fiscal {year}?", "State the second figure of {company} for {year}."]),
]


def _concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPT_ROWS, "key STRING, tags ARRAY<STRING>, unit STRING, phrasings ARRAY<STRING>")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"), F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession"),
        F.year("o_orderdate").alias("fiscal_year"), F.to_date("o_orderdate").alias("report_date"),
        F.when(F.col("o_custkey") % 4 == 0, "dev").otherwise("eval").alias("split"),
    )


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("c_custkey") % 4 == 0, "dev").otherwise("eval")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"), F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"),
        split.alias("split"), F.when(split == "eval", (F.col("c_custkey") % 2).cast("int")).alias("fold"),
        F.concat_ws("/", split, F.col("c_mktsegment")).alias("peer_group"),
    )


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as balances of the order's year end, one year back for even lines."""
    filings = _filings(spark, sf_dir).select("accession", "cik", "report_date", "fiscal_year")
    line = table(spark, sf_dir, "lineitem")
    joined = line.join(filings, F.col("l_orderkey") == F.col("accession"))
    end = F.make_date(F.year("report_date") - F.col("l_linenumber") % 8, F.month("report_date"), F.least(F.day("report_date"), F.lit(28)))
    return joined.select(
        "cik", F.lit(S.TAXONOMY).alias("taxonomy"), F.col("l_returnflag").alias("concept"), F.col("l_linestatus").alias("unit"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(S.MONEY).alias("value"), F.lit(None).cast("date").alias("start"), end.alias("end"),
        "fiscal_year", F.lit("10-K").alias("form"), "accession", F.col("report_date").alias("filed"),
        (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("ordinal"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, text), one row per line item: its price where the part number is even, else
    words only, so odd lines are the values that a filing does not print."""
    line = spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice")
    said = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Reported "), money_text(cents("l_extendedprice"))))
    return line.select(F.col("l_orderkey").alias("accession"), F.coalesce(said, F.lit("A price that was agreed upon")).alias("text"))


FACTS_SQL = """
facts AS (
  SELECT f.cik, l_returnflag AS concept, l_linestatus AS unit, l_extendedprice::DECIMAL(18,2) AS value, accession,
    make_date(year(report_date)::INT - l_linenumber % 8, month(report_date)::INT, least(day(report_date), 28)::INT) AS fact_end,
    l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ordinal
  FROM lineitem JOIN filings f ON l_orderkey = accession),
shown AS (SELECT DISTINCT l_orderkey AS accession, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem WHERE l_partkey % 2 = 0),
tags AS (SELECT 'a_or_r' AS key, unnest(['A', 'R']) AS concept, unnest([0, 1]) AS pos UNION ALL SELECT 'n', 'N', 0)
"""
TARGET = (
    "make_date(fiscal_year - years_before, month(report_date)::INT, "
    "CASE WHEN month(report_date) = 2 THEN least(day(report_date), 28) ELSE day(report_date) END::INT)"
)
# A printed 1,234.56 may stand for a value in units, thousands or millions; prices are below a
# million, so only units can match, and two decimals always have four digits or more.


@REGISTRY.query(
    "positive_facts",
    "WITH " + FILINGS_SQL + "," + FACTS_SQL
    + f""", w AS (SELECT accession, report_date, fiscal_year, years_before, key FROM filings, (SELECT unnest([0, 1]) AS years_before), (SELECT unnest(['a_or_r', 'n']) AS key)),
      t AS (SELECT *, {TARGET} AS target FROM w),
      m AS (SELECT t.accession, t.years_before, t.key, pos, min(value) <> max(value) AS conflict, min_by(value, ordinal) AS value
            FROM t JOIN tags USING (key) JOIN facts f ON f.accession = t.accession AND f.concept = tags.concept AND f.unit = 'O' AND abs(fact_end - target) <= 7
            GROUP BY 1, 2, 3, 4),
      first AS (SELECT *, row_number() OVER (PARTITION BY accession, years_before, key ORDER BY pos) AS r FROM m),
      c AS (SELECT w.accession, w.key, w.years_before, w.fiscal_year, f.conflict, f.value FROM w LEFT JOIN first f
            ON f.accession = w.accession AND f.key = w.key AND f.years_before = w.years_before AND r = 1)
      SELECT c.accession, c.key, c.years_before, c.fiscal_year - c.years_before AS period_year,
        CASE WHEN conflict THEN 'conflicting_values' WHEN value IS NULL THEN 'no_xbrl_fact' WHEN value = 0 THEN 'zero_value'
             WHEN s.v IS NULL THEN 'not_in_indexed_text' END AS drop_reason
      FROM c LEFT JOIN shown s ON s.accession = c.accession AND s.v = c.value""",
)
def positive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = PR.printed_numbers(_texts(spark, sf_dir))
    found = Q.positives(_filings(spark, sf_dir), _facts(spark, sf_dir), printed, _concepts(spark))
    return found.select("accession", "key", "years_before", "period_year", "drop_reason")


@REGISTRY.query(
    "wrong_year_facts",
    "WITH " + FILINGS_SQL + "," + FACTS_SQL
    + f""", w AS (SELECT accession, cik, report_date, fiscal_year, years_before, key FROM filings, (SELECT unnest([4, 5, 6, 7]) AS years_before), (SELECT unnest(['a_or_r', 'n']) AS key)),
      t AS (SELECT *, {TARGET} AS target FROM w),
      v AS (SELECT DISTINCT t.accession, t.key, t.years_before, value FROM t JOIN tags USING (key)
            JOIN facts f ON f.cik = t.cik AND f.concept = tags.concept AND f.unit = 'O' AND abs(fact_end - target) <= 7),
      p AS (SELECT v.accession, v.key, v.years_before, bool_or(s.v IS NOT NULL) AS printed
            FROM v LEFT JOIN shown s ON s.accession = v.accession AND s.v = v.value GROUP BY 1, 2, 3)
      SELECT w.accession, w.key, w.years_before,
        CASE WHEN printed IS NULL THEN 'no_value_for_year' WHEN printed THEN 'value_in_text' END AS drop_reason
      FROM w LEFT JOIN p USING (accession, key, years_before)""",
)
def wrong_year_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = materialize(PR.printed_numbers(_texts(spark, sf_dir)), "printed")
    found = Q.wrong_years(_filings(spark, sf_dir), _facts(spark, sf_dir), printed, _concepts(spark))
    return found.select("accession", "key", "years_before", "drop_reason")


@REGISTRY.query("golden_pool_select")
def golden_pool_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set over all orders: what each split and kind ends up with."""
    sector = spark.createDataFrame(
        [("deposits", "Deposits", "customer deposits", ["customer deposits"]), ("a", "A", "first figure", ["first figure"])],
        "key STRING, tag STRING, label STRING, absent_phrases ARRAY<STRING>",
    )
    off_domain = spark.createDataFrame(
        [("water", "What is the boiling point of water?", "boiling point"), ("report", "What did {company} say on toast?", "reported")],
        "key STRING, question STRING, marker STRING",
    )
    # A scope (company, year) has one filing: a customer's second order of a year is another company's.
    nth = F.row_number().over(Window.partitionBy("cik", "fiscal_year").orderBy("accession"))
    every = _filings(spark, sf_dir).withColumn("nth", nth)
    cik, ticker = F.col("cik") * 1000 + F.col("nth"), F.concat_ws(".", "ticker", "nth")
    made = every.select(F.col("ticker").alias("_customer"), "nth").distinct()
    customers = _companies(spark, sf_dir)
    companies = customers.join(made, F.col("ticker") == F.col("_customer")).select(
        ticker.alias("ticker"), cik.alias("cik"), F.concat_ws(" ", "name", "nth").alias("name"), "split", "fold", "peer_group"
    )
    filings = every.withColumns({"ticker": ticker, "cik": cik}).drop("nth")
    facts = _facts(spark, sf_dir).drop("cik").join(filings.select("accession", "cik"), "accession")
    texts = _texts(spark, sf_dir).groupBy("accession").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    corpus = PQ.Corpus(
        companies=companies, filings=filings, facts=facts, texts=texts,
        concepts=_concepts(spark), sector=sector,
        sector_phrasings=["What was {company}'s {label} in fiscal {year}?"], off_domain=off_domain,
    )
    tables = PQ.build(corpus, seed=17, quotas={"dev": (2, 4), "eval": (1, 3)})
    kind = F.coalesce("negative_kind", F.lit("positive")).alias("kind")
    return tables["cases"].groupBy("split", kind).agg(
        F.count("*").alias("cases"), F.count_if("e2e").alias("e2e"), F.count_distinct("ticker").alias("companies"),
        F.count_distinct("id").alias("ids"),
    )

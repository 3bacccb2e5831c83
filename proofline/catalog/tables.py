"""The given tables in the roles the operators expect, in Spark and, for the comparison, in SQL.

customer = company, orders = filing, lineitem = reported fact, events = case record, embeddings =
passage vectors, documents and pages = filing text, conversations = questions and answers.
Everything here is derived row by row from the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table about to be parsed or built into text, only the columns needed, over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns) if columns else table(spark, sf_dir, name))


# --- filings and facts ---------------------------------------------------------------------------
def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, cik, report_date, fiscal_year: one filing per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accession"),
        F.col("o_custkey").alias("cik"),
        F.to_date("o_orderdate").alias("report_date"),
        F.year("o_orderdate").alias("fiscal_year"),
    )


FILINGS_SQL = """
filings AS (
  SELECT o_orderkey AS accession, o_custkey AS cik, o_orderdate::DATE AS report_date,
         year(o_orderdate)::INT AS fiscal_year
  FROM orders)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reported value per line item; its period ends within ten days of a past year end."""
    line = table(spark, sf_dir, "lineitem")
    joined = line.join(filings(spark, sf_dir), F.col("l_orderkey") == F.col("accession"))
    back = F.make_date(
        F.year("report_date") - (F.col("l_linenumber") % 3), F.month("report_date"), F.least(F.day("report_date"), F.lit(28))
    )
    end = F.date_add(back, (F.col("l_partkey") % 21 - 10).cast("int"))
    return joined.select(
        "cik",
        F.lit(S.TAXONOMY).alias("taxonomy"),
        F.col("l_returnflag").alias("concept"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(S.MONEY).alias("value"),
        F.when(F.col("l_linestatus") == "F", F.date_sub(end, (340 + F.col("l_suppkey") % 50).cast("int"))).alias("start"),
        end.alias("end"),
        (F.col("fiscal_year") + F.when(F.col("l_quantity") % 4 == 0, 1).otherwise(0)).alias("fiscal_year"),
        F.when(F.col("l_suppkey") % 5 == 0, F.lit("10-Q")).otherwise(F.lit("10-K")).alias("form"),
        "accession",
        F.to_date("l_shipdate").alias("filed"),
        (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("ordinal"),
    )


FACTS_SQL = """
facts AS (
  SELECT *, CASE WHEN unit = 'F' THEN fact_end - (340 + l_suppkey % 50)::INT END AS fact_start
  FROM (
    SELECT f.cik, l_returnflag AS concept, l_linestatus AS unit,
           l_extendedprice::DECIMAL(18,2) AS value, l_suppkey,
           make_date(year(report_date)::INT - l_linenumber % 3, month(report_date)::INT,
                     least(day(report_date), 28)::INT) + (l_partkey % 21 - 10)::INT AS fact_end,
           fiscal_year + CASE WHEN l_quantity % 4 = 0 THEN 1 ELSE 0 END AS fiscal_year,
           CASE WHEN l_suppkey % 5 = 0 THEN '10-Q' ELSE '10-K' END AS form,
           accession, l_shipdate::DATE AS filed,
           l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ordinal
    FROM lineitem JOIN filings f ON l_orderkey = accession) t),
usable AS (
  SELECT * FROM facts
  WHERE fact_start IS NULL OR fact_end - fact_start BETWEEN 350 AND 380)
"""


# --- case records --------------------------------------------------------------------------------
def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case records from events: the value is the cosine score, the user the company."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = e.select("event_id", "user_id", "event_type", "value", k.alias("k"), "ts")
    outcome = (
        F.when(F.col("event_type") == "error", F.lit("model_declined"))
        .when(F.col("k") % 10 == 9, F.lit("no_valid_citation"))
        .when(F.col("k") % 10 == 8, F.lit("unsupported_claim"))
        .otherwise(F.lit("answered"))
    )
    answerable = F.col("event_type").isin("purchase", "signup")
    generated = F.lit(True)
    kinds = F.array(*[F.lit(n) for n in S.NEGATIVE_KINDS])
    return base.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 50 == 0, F.lit("narrative")).otherwise(F.lit("golden")).alias("kind"),
        F.lit("eval").alias("split"),
        (F.col("user_id") % 2).cast("int").alias("fold"),
        F.col("user_id").alias("ticker"),
        F.col("user_id").alias("cik"),
        F.year("ts").alias("fiscal_year"),
        answerable.alias("answerable"),
        F.when(~answerable, F.get(kinds, (F.col("event_id") % 4).cast("int"))).alias("negative_kind"),
        (F.col("k") % 2 == 0).alias("e2e"),
        F.create_map(
            F.lit("cosine"), F.col("value"),
            F.lit("recorded"), F.col("k").cast("double"),
            F.lit("period"), F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(1.0),
        ).alias("scores"),
        outcome.alias("outcome"),
        generated.alias("generated"),
        F.when(outcome == "answered", F.col("k") % 3 != 0).alias("numeric_correct"),
        F.when(outcome == "answered", F.col("k") % 4 != 0).alias("citation_supported"),
        F.col("value").alias("value"),
        F.col("k").alias("k"),
        F.create_map(
            F.lit("embed"), F.col("value"), F.lit("search"), F.col("k").cast("double"), F.lit("gate"), (F.col("event_id") % 97).cast("double")
        ).alias("stages"),
        F.when(F.col("k") % 11 != 0, F.col("k").cast("long")).alias("prompt_tokens"),
        F.when(F.col("k") % 13 != 0, (F.col("k") % 7).cast("long")).alias("completion_tokens"),
        F.when(F.col("k") % 5 != 0, F.col("value")).alias("generator_seconds"),
        F.concat(F.lit("Item "), (F.col("k") % 9).cast("string")).alias("expected_item"),
        F.array(F.concat(F.lit("Item "), (F.col("event_id") % 9).cast("string"))).alias("cited_items"),
        (F.col("event_id") % 6 != 0).alias("item_split_sane"),
    )


CASES_SQL = """
cases AS (
  SELECT *, outcome = 'answered' AS answered,
         coalesce(outcome = 'answered' AND k % 3 <> 0 AND k % 4 <> 0, false) AS correct
  FROM (
    SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'narrative' ELSE 'golden' END AS kind,
           (user_id % 2)::INT AS fold, user_id AS ticker,
           event_type IN ('purchase', 'signup') AS answerable,
           CASE WHEN event_type NOT IN ('purchase', 'signup') THEN
             ['wrong_year', 'other_company', 'unreported_concept', 'off_domain'][(event_id % 4)::INT + 1]
           END AS negative_kind,
           k % 2 = 0 AS e2e, value AS cosine, k::DOUBLE AS recorded,
           CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS period,
           CASE WHEN event_type = 'error' THEN 'model_declined'
                WHEN k % 10 = 9 THEN 'no_valid_citation'
                WHEN k % 10 = 8 THEN 'unsupported_claim' ELSE 'answered' END AS outcome,
           value, k, ts
    FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) e) t)
"""


# --- answers over line items ---------------------------------------------------------------------
def cents(column: str):
    """A price as whole cents."""
    return F.round(F.col(column) * 100).cast("long")


def money_text(value):
    """Whole cents as ``1,234.56``."""
    return F.concat(
        F.format_number(F.floor(value / 100), 0), F.lit("."), F.lpad((value % 100).cast("string"), 2, "0")
    )


def line_keys() -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

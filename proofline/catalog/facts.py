"""Queries over filings and reported facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.catalog.compare import REGISTRY
from proofline.catalog.tables import FACTS_SQL, FILINGS_SQL, facts, filings, table
from proofline.operators import facts as FA
from proofline.operators import pinning as PIN
from proofline.operators import retrieval as R

BASE = "WITH " + FILINGS_SQL + "," + FACTS_SQL
TARGET_SQL = (
    "make_date(fiscal_year - years_before, month(report_date)::INT, "
    "CASE WHEN month(report_date) = 2 THEN least(day(report_date), 28) ELSE day(report_date) END::INT)"
)


@REGISTRY.query(
    "latest_scope",
    "WITH " + FILINGS_SQL
    + """, one AS (SELECT cik, fiscal_year, min(accession) AS accession FROM filings GROUP BY 1, 2),
      q AS (SELECT c_custkey AS cik, unnest([NULL, 1998]) AS fiscal_year FROM customer),
      r AS (SELECT q.*, coalesce(q.fiscal_year, (SELECT max(o.fiscal_year) FROM one o WHERE o.cik = q.cik)) AS y FROM q)
      SELECT r.cik, r.fiscal_year, o.fiscal_year AS filing_year, o.accession, (o.cik IS NULL)::INT AS out_of_scope
      FROM r LEFT JOIN one o ON o.cik = r.cik AND o.fiscal_year = r.y""",
)
def latest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = filings(spark, sf_dir).groupBy("cik", "fiscal_year").agg(F.min("accession").alias("accession"))
    asked = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cik"), F.explode(F.array(F.lit(None).cast("int"), F.lit(1998))).alias("fiscal_year")
    )
    return R.resolve_scope(asked, one).withColumn("out_of_scope", F.col("out_of_scope").cast("int"))


@REGISTRY.query(
    "reported_fact_band",
    BASE
    + f""", w AS (SELECT accession, report_date, fiscal_year, concept, unit, years_before FROM filings,
            (SELECT unnest(['A', 'N', 'R']) AS concept), (SELECT unnest(['F', 'O']) AS unit), (SELECT unnest([0, 1]) AS years_before)),
      t AS (SELECT *, {TARGET_SQL} AS target FROM w)
      SELECT t.accession, t.concept, t.unit, t.years_before, count(u.ordinal) AS matches,
        (coalesce(min(u.value) <> max(u.value), false))::INT AS conflict, min_by(u.value, u.ordinal)::DOUBLE AS value
      FROM t LEFT JOIN usable u ON u.accession = t.accession AND u.concept = t.concept AND u.unit = t.unit
        AND abs(u.fact_end - t.target) <= 7
      GROUP BY 1, 2, 3, 4""",
)
def reported_fact_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    wanted = (
        filings(spark, sf_dir).select("accession", "report_date", F.lit(S.TAXONOMY).alias("taxonomy"))
        .withColumn("concept", each("A", "N", "R")).withColumn("unit", each("F", "O")).withColumn("years_before", each(0, 1))
    )
    found = FA.reported_facts(wanted, facts(spark, sf_dir))
    return found.select(
        "accession", "concept", "unit", "years_before", "matches", F.col("conflict").cast("int").alias("conflict"),
        F.col("fact.value").cast("double").alias("value"),
    )


@REGISTRY.query(
    "tag_fallback",
    BASE
    + f""", w AS (SELECT accession, report_date, fiscal_year, years_before, concept, pos FROM filings,
            (SELECT unnest([0, 1]) AS years_before), (SELECT unnest(['R', 'A', 'N']) AS concept, unnest([0, 1, 2]) AS pos)),
      t AS (SELECT *, {TARGET_SQL} AS target FROM w),
      m AS (SELECT t.accession, t.years_before, t.pos, t.concept, count(*) AS matches, min(u.value) <> max(u.value) AS conflict,
              min_by(u.value, u.ordinal) AS value
            FROM t JOIN usable u ON u.accession = t.accession AND u.concept = t.concept AND u.unit = 'O' AND abs(u.fact_end - t.target) <= 7
            GROUP BY 1, 2, 3, 4),
      f AS (SELECT *, row_number() OVER (PARTITION BY accession, years_before ORDER BY pos) AS r FROM m)
      SELECT k.accession, k.years_before, f.concept, coalesce(f.conflict, false)::INT AS conflict,
        f.value::DOUBLE AS value, coalesce(f.matches, 0) AS matches
      FROM (SELECT DISTINCT accession, years_before FROM w) k
      LEFT JOIN f ON f.accession = k.accession AND f.years_before = k.years_before AND f.r = 1""",
)
def tag_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filings(spark, sf_dir).select(
        "accession", "report_date", F.lit(S.TAXONOMY).alias("taxonomy"), F.lit("O").alias("unit"),
        F.array(F.lit("R"), F.lit("A"), F.lit("N")).alias("tags"), F.explode(F.array(F.lit(0), F.lit(1))).alias("years_before"),
    )
    found = FA.first_tag_reported(wanted, facts(spark, sf_dir))
    return found.select(
        "accession", "years_before", "concept", F.col("conflict").cast("int").alias("conflict"),
        F.col("fact.value").cast("double").alias("value"), "matches",
    )


@REGISTRY.query(
    "values_for_period",
    BASE
    + f""", w AS (SELECT accession, cik, report_date, fiscal_year, years_before, concept FROM filings,
            (SELECT 1 AS years_before), (SELECT unnest(['A', 'R']) AS concept)),
      t AS (SELECT *, {TARGET_SQL} AS target FROM w)
      SELECT DISTINCT t.accession, t.years_before, u.value::DOUBLE AS value
      FROM t JOIN usable u ON u.cik = t.cik AND u.concept = t.concept AND u.unit = 'F' AND abs(u.fact_end - t.target) <= 7""",
)
def values_for_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filings(spark, sf_dir).select(
        "accession", "cik", "report_date", F.lit("F").alias("unit"), F.array(F.lit("A"), F.lit("R")).alias("tags"), F.lit(1).alias("years_before")
    )
    values = FA.values_for_period(wanted, facts(spark, sf_dir))
    return values.select("accession", "years_before", F.col("value").cast("double").alias("value"))


@REGISTRY.query(
    "fiscal_label_mode",
    BASE
    + """, c AS (SELECT cik, accession, fiscal_year, count(*) AS n, min(ordinal) AS o FROM facts WHERE form = '10-K' GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY n DESC, o) AS k FROM c),
      f AS (SELECT accession, min(filed) AS first_filed FROM facts GROUP BY 1)
      SELECT cik, accession, fiscal_year, strftime(first_filed, '%Y-%m-%d') AS first_filed FROM r JOIN f USING (accession) WHERE k = 1""",
)
def fiscal_label_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = FA.labelled_filings(facts(spark, sf_dir))
    return labels.select("cik", "accession", "fiscal_year", F.date_format("first_filed", "yyyy-MM-dd").alias("first_filed"))


@REGISTRY.query(
    "filings_per_year",
    BASE
    + """, c AS (SELECT cik, accession, fiscal_year, count(*) AS n, min(ordinal) AS o FROM facts WHERE form = '10-K' GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY n DESC, o) AS k FROM c)
      SELECT cik, fiscal_year, count(*) AS filings, min(accession) AS accession FROM r WHERE k = 1 GROUP BY 1, 2""",
)
def filings_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.filings_per_year(FA.fiscal_labels(facts(spark, sf_dir)))


@REGISTRY.query(
    "trimmed_facts",
    BASE
    + """SELECT cik, concept, count(*) AS facts, count(*) FILTER (fact_start IS NULL) AS instants,
          count(*) FILTER (fact_end - fact_start BETWEEN 350 AND 380) AS annual, sum(fact_end - fact_start)::BIGINT AS days
        FROM facts WHERE form = '10-K' AND concept IN ('A', 'R') GROUP BY 1, 2""",
)
def trimmed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("concept")).where(F.col("concept") != "N")
    kept = FA.with_period(FA.trimmed(facts(spark, sf_dir), tags))
    return kept.groupBy("cik", "concept").agg(
        F.count("*").alias("facts"), F.count_if("is_instant").alias("instants"),
        F.count_if("is_annual").alias("annual"), F.sum("duration_days").alias("days"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).groupBy("cik", "fiscal_year").agg(
        F.date_add(F.min("report_date"), 3).alias("first_date"), F.date_sub(F.max("report_date"), 3).alias("last_date")
    ).select("cik", F.concat_ws("-", "cik", "fiscal_year").alias("name"), "first_date", "last_date")


@REGISTRY.query(
    "nearest_page",
    "WITH " + FILINGS_SQL
    + """, pages AS (SELECT cik, cik || '-' || fiscal_year AS name, min(report_date) + 3 AS first_date, max(report_date) - 3 AS last_date FROM filings GROUP BY cik, fiscal_year),
      d AS (SELECT f.cik, f.accession, name, greatest(0, first_date - (report_date + 5), (report_date + 5) - last_date) AS distance
            FROM filings f JOIN pages p USING (cik)),
      r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY distance, name) AS k, count(*) OVER (PARTITION BY accession) AS candidates
            FROM d WHERE distance <= 7)
      SELECT cik, accession, candidates, name, distance FROM r WHERE k = 1""",
)
def nearest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = filings(spark, sf_dir).select("cik", "accession", F.date_add("report_date", 5).alias("filed"))
    return FA.nearest_page(filed, _pages(spark, sf_dir)).drop("filed")


@REGISTRY.query(
    "pin_and_reserve",
    "WITH " + FILINGS_SQL
    + """, per AS (SELECT cik, fiscal_year, count(*) AS filings, min(accession) AS accession FROM filings GROUP BY 1, 2),
      w AS (SELECT c_custkey AS cik, unnest([1996, 1998]) AS fiscal_year FROM customer),
      bad AS (SELECT w.cik, min(w.fiscal_year) AS y, min_by(coalesce(filings, 0), w.fiscal_year) AS n
              FROM w LEFT JOIN per USING (cik, fiscal_year) WHERE coalesce(filings, 0) <> 1 GROUP BY 1),
      gaps AS (SELECT c_custkey AS ticker, n, row_number() OVER (ORDER BY c_custkey) AS k FROM customer JOIN bad ON cik = c_custkey WHERE c_custkey % 3 <> 0),
      spare AS (SELECT c_custkey AS replaced_by, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT cik FROM bad))
      SELECT ticker, n || ' 10-K filings carry the year' AS reason, replaced_by FROM gaps LEFT JOIN spare USING (k)""",
)
def pin_and_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = filings(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ticker"), F.col("c_custkey").alias("cik"), F.explode(F.array(F.lit(1996), F.lit(1998))).alias("fiscal_year")
    )
    pinned = PIN.pin_filings(wanted, FA.filings_per_year(filed), filed.withColumn("form", F.lit(S.ANNUAL_FORM)))
    roster = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ticker"), F.lit("eval").alias("split"), F.col("c_custkey").alias("position"), (F.col("c_custkey") % 3 == 0).alias("reserve")
    )
    return PIN.fill_from_reserves(roster, PIN.eligibility(pinned)).select("ticker", "reason", "replaced_by")

"""Which filing stands for each company and year, and which reserve fills a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.operators.running import running_totals


def pin_filings(wanted: DataFrame, per_year: DataFrame, listed: DataFrame) -> DataFrame:
    """Each wanted (ticker, cik, fiscal_year) with its filing, or the reason there is none.

    ``per_year``: cik, fiscal_year, filings, accession. ``listed``: accession, form, report_date.
    """
    joined = wanted.join(per_year, ["cik", "fiscal_year"], "left").join(
        listed.select("accession", "form", "report_date"), "accession", "left"
    )
    count = F.coalesce("filings", F.lit(0))
    reason = (
        F.when(count != 1, F.concat(count.cast("string"), F.lit(f" {S.ANNUAL_FORM} filings carry the year")))
        .when(F.col("form").isNull(), F.lit("no listing has the filing"))
        .when(F.col("form") != S.ANNUAL_FORM, F.concat(F.lit("the filing is a "), F.col("form")))
        .when(
            ~F.coalesce(F.year("report_date") == F.col("fiscal_year"), F.lit(False)),
            F.lit("the report date is in another year"),
        )
    )
    return joined.select(
        *wanted.columns, F.when(reason.isNull(), F.col("accession")).alias("accession"), "report_date", reason.alias("reason")
    )


def eligibility(pinned: DataFrame) -> DataFrame:
    """(ticker, eligible, reason): a company needs a filing for every year it was asked for."""
    failed = F.when(F.col("reason").isNotNull(), F.struct("fiscal_year", "reason"))
    return pinned.groupBy("ticker").agg(F.min(failed).alias("_first")).select(
        "ticker", F.col("_first").isNull().alias("eligible"), F.col("_first.reason").alias("reason")
    )


def fill_from_reserves(roster: DataFrame, eligible: DataFrame) -> DataFrame:
    """Listed companies that are not eligible, with the reserve that takes their place.

    ``roster``: ticker, split, position, reserve. Whether a reserve is eligible does not depend on
    the place it fills, so the k-th gap takes the k-th eligible reserve. ``replaced_by`` is null
    when the reserves run out.
    """
    known = roster.join(eligible, "ticker", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    ones = F.lit(1).cast("long").alias("_one")
    gaps = running_totals(
        known.where(~F.col("reserve") & ~F.col("eligible")).select("ticker", "split", "position", "reason", ones), "position", ["_one"]
    )
    spare = running_totals(
        known.where(F.col("reserve") & F.col("eligible")).select(F.col("ticker").alias("replaced_by"), "position", ones), "position", ["_one"]
    ).select("replaced_by", "_one_through")
    return gaps.join(spare, "_one_through", "left").select("ticker", "split", "position", "reason", "replaced_by")

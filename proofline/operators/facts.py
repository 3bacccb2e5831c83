"""Reported facts: which value a filing, or a company, reported for a fiscal year.

``facts`` has one row per reported value: cik, taxonomy, concept, unit, value, start, end,
fiscal_year, form, accession, filed, and ``ordinal``, its place in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import periods as P


def of_concept(facts: DataFrame, concept: str, taxonomy: str = S.TAXONOMY) -> DataFrame:
    return facts.where((F.col("concept") == concept) & (F.col("taxonomy") == taxonomy))


def with_period(facts: DataFrame) -> DataFrame:
    """Facts with ``is_instant``, ``duration_days`` and ``is_annual``."""
    start, end = F.col("start"), F.col("end")
    return facts.select(
        "*",
        P.is_instant(start).alias("is_instant"),
        P.duration_days(start, end).alias("duration_days"),
        P.is_annual(start, end).alias("is_annual"),
    )


def _usable(start: Column, end: Column) -> Column:
    return P.is_instant(start) | P.is_annual(start, end)


# Days of a bucket: the tolerance reaches into at most one neighbour, and mostly into none, so that
# most wanted rows move once.
BUCKET_DAYS = 16 * S.PERIOD_END_TOLERANCE_DAYS + 1


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS)


def _near_buckets(target: Column) -> Column:
    """The buckets in which a period end near ``target`` can lie: one or two."""
    reach = S.PERIOD_END_TOLERANCE_DAYS
    return F.array_distinct(F.array(_bucket(F.date_sub(target, reach)), _bucket(F.date_add(target, reach))))


def reported_facts(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """What each wanted (accession, taxonomy, concept, unit, report_date, years_before) reported.

    Every wanted row comes back with ``matches``, ``conflict`` (two different values) and ``fact``,
    the first match in source order; null when nothing matched. Facts of one period end are
    combined before they move, so a filing with a third of all facts arrives as its few period
    ends; these meet the wanted rows by the four keys. A wanted row moves once, and its matches
    are combined where it meets them.
    """
    keys = ["accession", "taxonomy", "concept", "unit"]
    ends = (
        facts.where(_usable(F.col("start"), F.col("end")))
        .groupBy(*keys, "end")
        .agg(
            F.count("*").alias("_n"),
            F.min("value").alias("_low"),
            F.max("value").alias("_high"),
            F.min_by(F.struct("value", "end", "start", "ordinal"), "ordinal").alias("_fact"),
        )
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("end").alias("_end"), "_n", "_low", "_high", "_fact")
    )
    asked = wanted.withColumn("_target", P.period_end(F.col("report_date"), F.col("years_before")))
    near = F.abs(F.date_diff(F.col("_end"), F.col("_target"))) <= S.PERIOD_END_TOLERANCE_DAYS
    joined = asked.join(ends, [*[F.col(k) == F.col(f"_{k}") for k in keys], near], "left")
    return joined.groupBy(*wanted.columns).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("matches"),
        F.coalesce(F.min("_low") != F.max("_high"), F.lit(False)).alias("conflict"),
        F.min_by("_fact", "_fact.ordinal").alias("fact"),
    )


def first_tag_reported(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Like ``reported_facts`` for rows with ``tags``, an ordered list of concepts: the first tag
    with any match decides, and its conflict stops the search."""
    tagged = wanted.select("*", F.posexplode("tags").alias("_tag_position", "concept"))
    found = reported_facts(tagged.drop("tags"), facts)
    keys = [c for c in wanted.columns if c != "tags"]
    hit = F.col("matches") > 0
    return found.groupBy(*keys).agg(
        F.min_by(
            F.when(hit, F.struct("concept", "conflict", "fact", "matches")),
            F.when(hit, F.col("_tag_position")),
        ).alias("_hit")
    ).select(
        *keys,
        F.col("_hit.concept").alias("concept"),
        F.coalesce("_hit.conflict", F.lit(False)).alias("conflict"),
        F.col("_hit.fact").alias("fact"),
        F.coalesce("_hit.matches", F.lit(0)).alias("matches"),
    )


def values_for_period(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Every distinct value a company's filings reported for a year: one row per wanted row and
    value, for wanted rows with cik, tags, unit, report_date and years_before. Repeats are removed
    before the join, and the bucket of the period end is part of its key."""
    keys = [c for c in wanted.columns if c != "tags"]
    target = P.period_end(F.col("report_date"), F.col("years_before"))
    asked = wanted.select(*keys, F.explode("tags").alias("concept"), _near_buckets(target).alias("_buckets"))
    asked = asked.select(*keys, "concept", F.explode("_buckets").alias("_bucket"))
    found = (
        facts.where(_usable(F.col("start"), F.col("end")) & (F.col("taxonomy") == S.TAXONOMY))
        .select("cik", "concept", "unit", F.col("end").alias("_end"), "value")
        .distinct()
        .withColumn("_bucket", _bucket(F.col("_end")))
    )
    joined = asked.join(found, ["cik", "concept", "unit", "_bucket"])
    near = F.abs(F.date_diff(F.col("_end"), target)) <= S.PERIOD_END_TOLERANCE_DAYS
    return joined.where(near).select(*keys, "value").distinct()


def fiscal_labels(facts: DataFrame, form: str = S.ANNUAL_FORM) -> DataFrame:
    """(cik, accession, fiscal_year): the year most of a filing's facts carry, the one met first
    where two are even."""
    counts = (
        facts.where((F.col("form") == form) & F.col("fiscal_year").isNotNull())
        .groupBy("cik", "accession", "fiscal_year")
        .agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    )
    return counts.groupBy("cik", "accession").agg(
        F.max_by("fiscal_year", F.struct(F.col("n"), -F.col("first"))).alias("fiscal_year")
    )


def labelled_filings(facts: DataFrame, form: str = S.ANNUAL_FORM) -> DataFrame:
    """``fiscal_labels`` with ``first_filed``, from one pass over the facts: they are counted by filing and
    year first, and every step after reads those counts where they are."""
    annual = (F.col("form") == form) & F.col("fiscal_year").isNotNull()
    counts = (
        facts.where(F.col("accession").isNotNull())
        .groupBy("accession", "cik", "fiscal_year")
        .agg(F.count_if(annual).alias("n"), F.min(F.when(annual, F.col("ordinal"))).alias("first"), F.min("filed").alias("_filed"))
    )
    place = F.when(F.col("n") > 0, F.struct(F.col("n"), -F.col("first")))
    labels = counts.groupBy("accession", "cik").agg(
        F.max_by("fiscal_year", place).alias("fiscal_year"), F.max("n").alias("n"), F.min("_filed").alias("_filed")
    )
    # An accession has one company but for errors of the source; the first date is that of all of them.
    every = labels.groupBy("accession").agg(
        F.min("_filed").alias("first_filed"), F.collect_list(F.when(F.col("n") > 0, F.struct("cik", "fiscal_year"))).alias("_labels")
    )
    return every.select("accession", "first_filed", F.inline("_labels")).select("cik", "accession", "fiscal_year", "first_filed")


def filings_per_year(labels: DataFrame) -> DataFrame:
    """(cik, fiscal_year, filings, accession): how many filings carry a year, and the first."""
    return labels.groupBy("cik", "fiscal_year").agg(
        F.count("*").alias("filings"), F.min("accession").alias("accession")
    )


def first_filed(facts: DataFrame) -> DataFrame:
    return facts.groupBy("accession").agg(F.min("filed").alias("first_filed"))


def trimmed(facts: DataFrame, tags: DataFrame, form: str = S.ANNUAL_FORM) -> DataFrame:
    """Facts of one form whose concept is wanted."""
    return facts.where((F.col("form") == form) & (F.col("taxonomy") == S.TAXONOMY)).join(
        tags.select("concept").distinct(), "concept", "left_semi"
    )


def reported_concepts(facts: DataFrame) -> DataFrame:
    """(cik, concept): everything a company ever reported, in any form."""
    return facts.where(F.col("taxonomy") == S.TAXONOMY).select("cik", "concept").distinct()


def pages_near(filings: DataFrame, pages: DataFrame, within: int = S.NEAREST_PAGE_DAYS) -> DataFrame:
    """Older listing pages of a filing's company near its filing date.

    ``filings``: cik, accession, filed. ``pages``: cik, name, first_date, last_date. A page stands
    in every month it can reach, and a filing meets the pages of its month only.
    """
    month = lambda day: F.floor(F.unix_date(day) / 30)
    earliest = F.date_sub(F.least("first_date", "last_date"), within)
    latest = F.date_add(F.greatest("first_date", "last_date"), within)
    placed = pages.withColumn("_month", F.explode(F.sequence(month(earliest), month(latest))))
    joined = filings.withColumn("_month", month(F.col("filed"))).join(placed, ["cik", "_month"]).drop("_month")
    distance = F.greatest(
        F.lit(0),
        F.date_diff(F.col("first_date"), F.col("filed")),
        F.date_diff(F.col("filed"), F.col("last_date")),
    )
    return joined.withColumn("distance", distance).where(F.col("distance") <= within)


def nearest_page(filings: DataFrame, pages: DataFrame, within: int = S.NEAREST_PAGE_DAYS) -> DataFrame:
    """One row per filing with a page in reach: the nearest, the first by name where two are even."""
    return pages_near(filings, pages, within).groupBy("cik", "accession", "filed").agg(
        F.min(F.struct("distance", "name")).alias("_best"), F.count("*").alias("candidates")
    ).select(
        "cik", "accession", "filed", "candidates",
        F.col("_best.name").alias("name"), F.col("_best.distance").alias("distance"),
    )


def nearest_listing(filings: DataFrame, pages: DataFrame, listed: DataFrame, within: int = S.NEAREST_PAGE_DAYS) -> DataFrame:
    """The nearest page that lists the filing. ``listed``: cik, name, accession."""
    near = pages_near(filings, pages, within).join(listed, ["cik", "name", "accession"], "left_semi")
    return near.groupBy("cik", "accession", "filed").agg(
        F.min(F.struct("distance", "name")).alias("_best")
    ).select("cik", "accession", "filed", F.col("_best.name").alias("name"), F.col("_best.distance").alias("distance"))

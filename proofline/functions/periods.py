"""Years a question names, and the ends of fiscal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import schemas as S

# --- fixed values: how a year is written ---------------------------------------------------------
FOUR_DIGIT_YEAR = r"(?U)\b((?:19|20)\d{2})\b"
FISCAL_SHORT_YEAR = r"(?iU)\bFY ?['’]?(\d{4}|\d{2})\b"


def years_named(question: Column, near: Column) -> Column:
    """Sorted years of a question; a two-digit ``FY24`` is read as the closest year to ``near``."""
    plain = F.transform(
        F.regexp_extract_all(question, F.lit(FOUR_DIGIT_YEAR), F.lit(1)), lambda y: y.cast("int")
    )

    def fiscal(digits: Column) -> Column:
        number = digits.cast("int")
        same_century = near - near % 100 + number
        nearby = F.array(
            *[
                F.struct(
                    F.abs(same_century + shift - near).alias("away"),
                    F.lit(order).alias("order"),
                    (same_century + shift).alias("year"),
                )
                for order, shift in enumerate((-100, 0, 100))
            ]
        )
        return F.when(F.length(digits) == 4, number).otherwise(F.array_min(nearby)["year"])

    short = F.transform(
        F.regexp_extract_all(question, F.lit(FISCAL_SHORT_YEAR), F.lit(1)), fiscal
    )
    return F.array_sort(F.array_distinct(F.concat(plain, short)))


def years_outside(years: Column, fiscal_year: Column, reported: int = S.YEARS_REPORTED) -> Column:
    """The named years a filing of ``fiscal_year`` does not report."""
    return F.filter(years, lambda y: ~y.between(fiscal_year - (reported - 1), fiscal_year))


def listed(years: Column) -> Column:
    return F.array_join(F.transform(years, lambda y: y.cast("string")), ", ")


def period_end(report_date: Column, years_before: Column | int = 0) -> Column:
    """End of the fiscal year ``years_before`` years earlier; 29 February becomes the 28th."""
    back = F.lit(years_before) if isinstance(years_before, int) else years_before
    day = F.when(F.month(report_date) == 2, F.least(F.day(report_date), F.lit(28))).otherwise(
        F.day(report_date)
    )
    return F.make_date(F.year(report_date) - back, F.month(report_date), day)


def is_instant(start: Column) -> Column:
    return start.isNull()


def duration_days(start: Column, end: Column) -> Column:
    return F.date_diff(end, start)


def is_annual(start: Column, end: Column) -> Column:
    days = duration_days(start, end)
    return F.coalesce(days.between(S.ANNUAL_MIN_DAYS, S.ANNUAL_MAX_DAYS), F.lit(False))

"""Whether a value is printed in a text, in any way a filing prints it.

A number without a scale word can stand for units, thousands or millions; one with a scale word
only for itself. A value is printed when rounding it to the step a printed number shows gives that
number. The strict rule keeps positives, the loose one keeps negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline import schemas as S
from proofline.functions import amounts as A

# --- fixed values: what a bare number may count in, as powers of ten, and the step of a cent -------
BARE_POWERS = (0, 3, 6)
CENT_POWER = 7


def _digits_above(digits: Column, power: Column) -> Column:
    """A whole number written in digits, divided by a power of ten and rounded down."""
    kept = F.length(digits) - power
    return F.when(kept > 0, F.left(digits, kept)).otherwise(F.lit("0"))


def printed_numbers(texts: DataFrame, key: str = "accession", text: str = "text") -> DataFrame:
    """(key, kind, power, units, digits): every number a text prints, once, with the most digits it
    was written with.

    A number is ``units`` steps of ten to the ``power`` billionths. ``units`` is text, so a number
    of any length is exact and a cheap key. Repeats combine before the shuffle.
    """
    figures = texts.select(key, F.explode(A.amounts_in(F.col(text))).alias("_a")).where("_a.is_readable")
    step_power = F.length(F.col("_a.step").cast("string")) - 1
    size = F.abs(F.col("_a.nano")).cast("string")
    return (
        figures.select(
            key,
            F.when(A.is_scaled(F.col("_a.text")), F.lit("scaled")).otherwise(F.lit("bare")).alias("kind"),
            step_power.alias("power"),
            _digits_above(size, step_power).alias("units"),
            A.first_number_digits(F.col("_a.text")).alias("digits"),
        )
        .groupBy(key, "kind", "power", "units")
        .agg(F.max("digits").alias("digits"))
    )


def _neighbours(digits: Column, power: Column) -> Column:
    """array<struct<units, nearest>>: the whole steps a value rounds to, one, or two when it lies
    half-way. ``nearest`` marks the one that rounding half to even takes."""
    below = _digits_above(digits, power)
    above = (below.cast(S.TICKS) + 1).cast("string")
    rest = F.lpad(F.when(F.length(digits) > power, F.right(digits, power)).otherwise(digits), power, F.lit("0"))
    half = F.rpad(F.lit("5"), power, F.lit("0"))
    even = F.right(below, F.lit(1)).isin("0", "2", "4", "6", "8")
    row = lambda units, nearest: F.struct(units.alias("units"), nearest.alias("nearest"))
    return (
        F.when((power == 0) | (rest < half), F.array(row(below, F.lit(True))))
        .when(rest > half, F.array(row(above, F.lit(True))))
        .otherwise(F.array(row(below, even), row(above, ~even)))
    )


def lookup(values: DataFrame, printed: DataFrame, key: str = "accession") -> DataFrame:
    """``values`` (key, nano, per_share, and anything else) with ``bare_digits``,
    ``scaled_digits``, ``in_cents``, ``prints`` and ``may_print``.

    A value can only match what it rounds to at each step a text uses, so the search is an
    equality join on (key, kind, step, units) and never compares a value with every number.
    Both tables are read twice, so they should be written, not computed where they are read.
    """
    powers = printed.groupBy(key, "kind").agg(
        # Steps are powers of ten: at most a few dozen per text.
        F.collect_set("power").alias("_powers")
    )
    target = F.abs(F.col("nano")).cast("string")
    asked = values.select(key, target.alias("_target")).where(F.col("_target").isNotNull()).distinct()
    stands = F.when(F.col("kind") == "bare", F.array(*[F.lit(p) for p in BARE_POWERS])).otherwise(F.array(F.lit(0)))
    near = asked.join(powers, key).select(
        key, "_target", "kind", F.explode("_powers").alias("power"), stands.alias("_stands")
    ).select(key, "_target", "kind", "power", F.explode("_stands").alias("_shift"))
    probes = near.select(
        key, "_target", "kind", "power", "_shift", F.explode(_neighbours(F.col("_target"), F.col("power") + F.col("_shift"))).alias("_n")
    ).select(key, "_target", "kind", "power", "_shift", "_n.units", "_n.nearest")
    bare = F.col("kind") == "bare"
    hits = (
        probes.join(printed, [key, "kind", "power", "units"])
        .groupBy(key, "_target")
        .agg(
            F.max(F.when(bare, F.col("digits"))).alias("bare_digits"),
            F.max(F.when(~bare, F.col("digits"))).alias("scaled_digits"),
            F.bool_or(bare & (F.col("power") == CENT_POWER) & (F.col("_shift") == 0) & F.col("nearest")).alias("in_cents"),
        )
    )
    joined = values.withColumn("_target", target).join(hits, [key, "_target"], "left")
    bare_digits = F.coalesce("bare_digits", F.lit(0))
    scaled_digits = F.coalesce("scaled_digits", F.lit(0))
    in_cents = F.coalesce("in_cents", F.lit(False))
    whole_cents = F.right("_target", F.lit(CENT_POWER)).isin("0", "0" * CENT_POWER)
    loose = F.greatest(bare_digits, scaled_digits) >= S.LOOSE_DIGITS
    return joined.select(
        *values.columns,
        bare_digits.alias("bare_digits"),
        scaled_digits.alias("scaled_digits"),
        in_cents.alias("in_cents"),
        F.when(F.col("per_share"), whole_cents & in_cents)
        .otherwise((bare_digits >= S.STRICT_BARE_DIGITS) | (scaled_digits >= S.STRICT_SCALED_DIGITS))
        .alias("prints"),
        (loose | (F.col("per_share") & in_cents)).alias("may_print"),
    )


def _times(value: Column, power: int) -> Column:
    return F.try_multiply(value, F.lit(10**power).cast(T.DecimalType(7, 0))).cast(S.TICKS)


def prints_in(text: Column, nano: Column, per_share: Column) -> Column:
    """The strict rule for one text and one value, without an index: for a handful of passages."""
    target = F.abs(nano)

    def strict(a: Column) -> Column:
        digits = A.first_number_digits(a["text"])
        value = F.abs(a["nano"])
        scaled = A.is_scaled(a["text"])
        near = [
            F.abs(_times(value, m) - target) * 2 <= _times(a["step"], m) for m in BARE_POWERS
        ]
        as_bare = (near[0] | near[1] | near[2]) & (digits >= S.STRICT_BARE_DIGITS)
        as_scaled = near[0] & (digits >= S.STRICT_SCALED_DIGITS)
        as_cents = ~scaled & (a["step"] == 10**CENT_POWER) & (value == target)
        return a["is_readable"] & F.when(per_share, as_cents).otherwise(
            F.when(scaled, as_scaled).otherwise(as_bare)
        )

    return F.coalesce(F.exists(A.amounts_in(text), strict), F.lit(False))

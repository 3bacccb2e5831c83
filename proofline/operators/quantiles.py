"""Exact quantiles by group, without holding a group's values in one state.

A sketch with a known error brackets every wanted rank first. Only values inside a bracket are then
counted, each distinct value once, and how many lie below it. Running totals over those (cut into
buckets, see ``running``) find the value at a rank. A bracket that turns out not to hold its ranks
is opened on the side it missed and counted again, so the sketch decides work and no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.running import running_totals
from proofline.session import materialize

ACCURACY = 10_000
LEAST, MOST = float("-inf"), float("nan")  # Spark orders not-a-number after every number


def _counted(values: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, _which, _v, _rows): rows per distinct value of a bracket; ``_v`` null: below it."""
    placed = values.join(targets.select(*by, "_which", "_lo", "_hi"), by).where(F.col("_v") <= F.col("_hi"))
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    return placed.groupBy(*by, "_which", inside.alias("_v")).agg(F.count("*").alias("_rows"))


def _checked(targets: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    sums = counted.groupBy(*by, "_which").agg(
        F.sum(F.when(F.col("_v").isNull(), F.col("_rows")).otherwise(0)).alias("_below"),
        F.sum("_rows").alias("_through"),
    )
    none = F.lit(0).cast("long")
    return targets.join(sums, [*by, "_which"], "left").withColumns(
        {"_below": F.coalesce("_below", none), "_through": F.coalesce("_through", none)}
    )


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(by..., rows, n, q): rows and values of each group, and its quantiles at ``shares``, interpolated
    between neighbours, in one array of doubles.

    Null values are rows without a value: they count in ``rows`` only; a group without values has
    null quantiles. Groups with a null key are groups. Not-a-number comes after every number.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    given = [F.to_json(F.struct(F.col(c).alias("k"))) for c in by] or [F.lit("")]
    spots = range(len(shares))
    values = rows.select(*[g.alias(k) for g, k in zip(given, keys)], F.col(value).cast("double").alias("_v"))
    margin = 2 / accuracy

    def bracket(share: float) -> Column:
        ends = F.array(F.lit(max(share - margin, 0.0)), F.lit(min(share + margin, 1.0)))
        return F.percentile_approx("_v", ends, F.lit(accuracy))

    # The names of a group are its own columns, whatever they hold; keys are only for joins.
    named = rows.select(*by, *[g.alias(k) for g, k in zip(given, keys)], F.col(value).cast("double").alias("_v"))
    groups = materialize(
        named.groupBy(*by, *keys).agg(
            F.count("*").alias("rows"), F.count("_v").alias("n"), *[bracket(s).alias(f"_b{i}") for i, s in enumerate(shares)]
        ),
        "quantile-groups",
    )
    position = F.col("_share") * (F.col("n") - 1)
    targets = (
        groups.where("n > 0")
        .select(
            *keys,
            "n",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("_which"), F.lit(float(shares[i])).alias("_share"),
                            F.get(f"_b{i}", F.lit(0)).alias("_lo"), F.get(f"_b{i}", F.lit(1)).alias("_hi"),
                        )
                        for i in spots
                    ]
                )
            ),
        )
        .select(*keys, "_which", "_lo", "_hi", position.alias("_at"), F.floor(position).alias("_low"), F.ceil(position).alias("_high"))
    )
    values = values.where(F.col("_v").isNotNull())
    counted = materialize(_counted(values, targets, keys), "quantile-counts")
    checked = _checked(targets, counted, keys)
    short = F.col("_low") < F.col("_below")
    over = F.col("_high") >= F.col("_through")
    if checked.where(short | over).limit(1).count():
        targets = checked.select(
            *keys, "_which", "_at", "_low", "_high",
            F.when(short, F.lit(LEAST)).otherwise(F.col("_lo")).alias("_lo"),
            F.when(over, F.lit(MOST)).otherwise(F.col("_hi")).alias("_hi"),
        )
        counted = materialize(_counted(values, targets, keys), "quantile-counts")
        checked = _checked(targets, counted, keys)
    inside = counted.where(F.col("_v").isNotNull())
    totals = running_totals(inside, "_v", ["_rows"], by=[*keys, "_which"])
    reached = totals.join(checked.select(*keys, "_which", "_at", "_low", "_high", "_below"), [*keys, "_which"])
    upto = F.col("_below") + F.col("_rows_through")
    ends = reached.groupBy(*keys, "_which", "_at", "_low", "_high").agg(
        F.min(F.when(upto > F.col("_low"), F.col("_v"))).alias("_first"),
        F.min(F.when(upto > F.col("_high"), F.col("_v"))).alias("_second"),
    )
    between = F.when(
        F.col("_first") == F.col("_second"), F.col("_first")
    ).otherwise((F.col("_high") - F.col("_at")) * F.col("_first") + (F.col("_at") - F.col("_low")) * F.col("_second"))
    found = ends.groupBy(*keys).agg(
        F.array(*[F.max(F.when(F.col("_which") == i, between)) for i in spots]).alias("q")
    )
    return groups.join(found, keys, "left").select(*by, "rows", "n", "q")

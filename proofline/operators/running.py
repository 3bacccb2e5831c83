"""Running totals over an order, without sending the order through one task.

Rows with the same value are aggregated first, so a value shared by a third of all rows is one
row. Distinct values are then cut into buckets at approximate quantiles; totals run inside each
bucket in parallel, and the totals of the buckets before are added from a table with one row per
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BUCKETS = 2000


def bucket_count(df: DataFrame) -> int:
    return min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def with_bucket(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, a number that grows with ``order``.

    The cut points are one row of at most ``MAX_BUCKETS`` values, so joining them to every row is
    a broadcast of known size. Where they fall only decides how work is spread, never a result.
    """
    wanted = buckets or bucket_count(df)
    shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)]) if wanted > 1 else None
    if shares is None:
        return df.withColumn("_bucket", F.lit(0))
    cuts = df.agg(F.percentile_approx(order, shares, F.lit(10_000)).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts))
    value = F.col(order)
    return placed.withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda cut: cut < value))
    ).drop("_cuts")


def running_totals(
    values: DataFrame,
    order: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """``values`` (one row per ``by`` and ``order``) with ``<sum>_through`` for every column of
    ``sums``: its total over all rows up to and including this one, in the order asked for.

    Text has no quantiles; it is ordered by its hash first, which is a fixed order too and spreads
    evenly.
    """
    by = by or []
    if dict(values.dtypes)[order] == "string":
        wanted = buckets or bucket_count(values)
        placed = values.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(wanted)).cast("int"))
    else:
        placed = with_bucket(values, order, buckets)
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())

    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    # At most MAX_BUCKETS rows per group, whatever the size of the data.
    before = Window.partitionBy(*by).orderBy(direction(F.col("_bucket"))).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(F.col(order))).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    through = placed.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    joined = through.join(offsets, [*by, "_bucket"])
    return joined.select(
        *values.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"{s}_through") for s in sums],
    )


def first_in_order(df: DataFrame, order: str, count: Column | int) -> DataFrame:
    """The first ``count`` rows by a unique ``order`` column, with ``position`` from one."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    ranked = ranked.withColumnRenamed("_one_through", "position").drop("_one")
    return ranked.where(F.col("position") <= count)

"""Seeded sampling that spreads over facts and concepts, quotas, and folds.

Order comes from SHA-256 or MD5 of the seed and a row's own key, so adding rows to one stratum
never changes the picks of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline import schemas as S
from proofline.operators.running import running_totals


def hash_order(seed: int | str, *parts: Column) -> Column:
    """A text to order by: uniform, repeatable, and different for every seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(seed: int | str, *parts: Column) -> Column:
    """The same order as a 60-bit number, which has quantiles."""
    return F.conv(F.substr(hash_order(seed, *parts), F.lit(1), F.lit(15)), 16, 10).cast("long")


def kind_quota(total: Column, position: Column, kinds: tuple[str, ...] = S.NEGATIVE_KINDS) -> Column:
    """array<struct<kind, quota>>: ``total`` over the kinds, the remainder rotating with ``position``."""
    count = len(kinds)
    base, extra = F.floor(total / count), total % count
    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                (base + (F.pmod(F.lit(i) - position, F.lit(count)) < extra).cast("int")).cast("long").alias("quota"),
            )
            for i, kind in enumerate(kinds)
        ]
    )


def fact_group() -> Column:
    """Cases that only phrase one question about one fact differently share this key."""
    return F.struct(
        F.col("accession"),
        F.coalesce("negative_kind", F.lit("positive")).alias("kind"),
        F.coalesce("asked_company", F.lit("")).alias("asked"),
        F.coalesce("concept", F.col("template")).alias("about"),
        F.col("period_year"),
    )


def spread_key() -> Column:
    return F.coalesce("concept", F.col("template"))


def spread_sample(
    cases: DataFrame,
    stratum: list[str],
    quota: str,
    largest_quota: int,
    seed: int,
    group: Column | None = None,
    concept: Column | None = None,
    case_id: str = "id",
    forced: str | None = None,
) -> DataFrame:
    """The first ``quota`` cases of each stratum: one per group before a second of any, groups
    taken so that concepts rotate.

    Only the first ``largest_quota`` groups of a concept and cases of a group can be picked, so
    every rank is cut there before rows move, and a stratum with a third of all cases sends a
    bounded number of rows from each task. ``forced`` names a boolean column of cases that come
    first.
    """
    group_key = F.to_json(F.struct((group if group is not None else fact_group()).alias("g")))
    named = cases.select(
        "*",
        group_key.alias("_group"),
        (concept if concept is not None else spread_key()).alias("_concept"),
        (F.col(forced) if forced else F.lit(False)).alias("_forced"),
    )
    parts = [F.col(c) for c in stratum]
    keyed = named.select(
        "*",
        hash_order(seed, *parts, F.col("_group")).alias("_group_order"),
        hash_order(seed, *parts, F.col(case_id)).alias("_case_order"),
    )
    depth = F.row_number().over(
        Window.partitionBy(*stratum, "_group").orderBy(F.desc("_forced"), "_case_order", case_id)
    )
    members = keyed.withColumn("_depth", depth).where(F.col("_depth") <= largest_quota)
    rounds = (
        keyed.groupBy(*stratum, "_concept", "_group", "_group_order")
        .agg(F.bool_or("_forced").alias("_has_forced"))
        .withColumn(
            "_round",
            F.row_number().over(
                Window.partitionBy(*stratum, "_concept").orderBy(
                    F.desc("_has_forced"), "_group_order", "_group"
                )
            ),
        )
        .where(F.col("_round") <= largest_quota)
        .select(*stratum, "_group", "_round")
    )
    ranked = members.join(rounds, [*stratum, "_group"]).withColumn(
        "pick",
        F.row_number().over(
            Window.partitionBy(*stratum).orderBy(
                F.desc("_forced"), "_depth", "_round", "_group_order", "_group", "_case_order", case_id
            )
        ),
    )
    picked = ranked.where(F.col("pick") <= largest_quota).where(F.col("pick") <= F.col(quota))
    return picked.select(*cases.columns, "pick", F.col("_depth").alias("depth"), F.col("_round").alias("round"))


def shortages(quotas: DataFrame, pool: DataFrame, stratum: list[str], distinct_groups: bool = False) -> DataFrame:
    """Strata whose pool, or whose number of distinct facts, is below their quota."""
    size = F.count_distinct(F.to_json(F.struct(fact_group().alias("g")))) if distinct_groups else F.count("*")
    sizes = pool.groupBy(*stratum).agg(size.alias("available"))
    joined = quotas.join(sizes, stratum, "left")
    return joined.withColumn("available", F.coalesce("available", F.lit(0))).where(F.col("available") < F.col("quota"))


def even_allocation(capacity: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, position, capacity, allocation): ``total`` places handed out one at a time in
    order of ``position``, never past a capacity.

    Going round is the same as filling every name to one level and giving the rest to the first
    names that still have room, so no place is ever a row. ``capacity``: by, name, position,
    capacity. ``total``: by, total; where it exceeds the sum of capacities every name is full.
    """
    levels = capacity.groupBy(*by, "capacity").agg(F.count("*").alias("names"))
    filled = levels.withColumn("held", F.col("capacity") * F.col("names"))
    through = running_totals(filled, "capacity", ["names", "held"], by)
    sizes = levels.groupBy(*by).agg(F.sum("names").alias("_all"))
    # Places used when every name is filled to this capacity.
    used = through.join(sizes, by).select(
        *by,
        F.col("capacity").alias("_level"),
        (F.col("held_through") + F.col("capacity") * (F.col("_all") - F.col("names_through"))).alias("_used"),
        (F.col("_all") - F.col("names_through")).alias("_open"),
    )
    reached = used.join(total, by).where(F.col("_used") <= F.col("total"))
    best = reached.groupBy(*by).agg(F.max_by(F.struct("_level", "_used", "_open"), "_level").alias("_b"))
    state = total.join(best, by, "left").join(sizes, by, "left").select(
        *by,
        F.coalesce("_b._level", F.lit(0)).alias("_level"),
        (F.col("total") - F.coalesce("_b._used", F.lit(0))).alias("_left"),
        F.coalesce("_b._open", F.col("_all")).alias("_open"),
    )
    whole = state.select(
        *by,
        (F.col("_level") + F.when(F.col("_open") > 0, F.floor(F.col("_left") / F.col("_open"))).otherwise(0)).alias("_base"),
        F.when(F.col("_open") > 0, F.col("_left") % F.col("_open")).otherwise(0).alias("_extra"),
    )
    placed = capacity.join(whole, by).withColumn(
        "_room", (F.col("capacity") > F.col("_base")).cast("long")
    )
    ordered = running_totals(placed, "position", ["_room"], by)
    extra = ((F.col("_room") == 1) & (F.col("_room_through") <= F.col("_extra"))).cast("long")
    return ordered.select(
        *by, "name", "position", "capacity",
        (F.least(F.col("capacity"), F.col("_base")) + extra).alias("allocation"),
    )


def two_folds(companies: DataFrame, seed: int, name: str = "ticker") -> DataFrame:
    """``companies`` with ``fold``: 0 for the first half in a seeded order, 1 for the rest."""
    ordered = companies.select(
        "*", hash_number(seed, F.col(name)).alias("_order"), F.lit(1).cast("long").alias("_one")
    )
    ranked = running_totals(ordered, "_order", ["_one"])
    size = companies.agg(F.count("*").alias("_size"))
    return ranked.crossJoin(F.broadcast(size)).select(
        *companies.columns,
        F.when(F.col("_one_through") <= F.floor(F.col("_size") / 2), F.lit(0)).otherwise(F.lit(1)).alias("fold"),
    )


def first_by_hash(cases: DataFrame, count: int, case_id: str = "id") -> DataFrame:
    """The first ``count`` cases in a fixed order that says nothing about their content."""
    return cases.orderBy(F.sha2(F.col(case_id).cast("string"), 256)).limit(count)

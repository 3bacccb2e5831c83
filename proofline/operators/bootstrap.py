"""Cluster bootstrap: whole clusters are drawn with replacement, inside their stratum.

A replicate is never built row by row. Clusters are reduced to sums first, and a replicate adds
the sums of the clusters it drew. The clusters of a stratum are cut into leaves. How many of a
replicate's draws fall into a leaf is split from the stratum's total down a tree of halves, each
split a binomial number keyed by (seed, replicate, stratum, node); inside a leaf a draw is a hash of
(seed, replicate, stratum, slot). So a task makes the weights of its own leaf, no draw is ever a
row, and draws are the same on every run, in any order, and after a lost executor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from proofline import schemas as S
from proofline.functions.statistics import check_confidence, effect_factor
from proofline.operators.running import MAX_BUCKETS, running_totals, with_bucket
from proofline.session import materialize, temporary

#: Replicates whose weights are one matrix, histogram rows of a bucket (about) and rows multiplied at once.
CHUNK, BUCKET_ROWS, SLICE_ROWS = 100, 1 << 22, 1 << 12
#: Clusters of a leaf, and ranges of replicates over which the work on a leaf is dealt.
LEAF, RANGES = 4096, 16
#: Bytes that the steps of an AUROC's pass move (about), of a histogram row and of a weight with what goes with it.
#: A pass is as many ranges as fit, one at least.
PASS_BYTES, HIST_BYTES, KEY_BYTES = 1 << 31, 40, 40
#: Groups in which the states of leaves are merged first.
MERGED = 64
#: Replicates whose draws from a leaf are hashed together.
TOGETHER = 10
#: Start, constants and turns of MD5 (fixed values).
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_CONSTANTS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURNS = [turn for part in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in part * 4]


def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters`` (stratum, cluster, ...) with ``position`` from 0 inside each stratum.

    The order only has to be fixed. Strata may be few and large, so positions are running totals
    over buckets and not one window per stratum.
    """
    ones = clusters.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(ones, "cluster", ["_one"], ["stratum"])
    return ranked.withColumn("position", F.col("_one_through") - 1).drop("_one", "_one_through")


def _leaf_draws(k: int, lo: int, hi: int, leaf: int, size: int, key: str) -> int:
    """How many of ``k`` draws from the leaves lo to hi - 1 fall into ``leaf``."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first, cut, last = lo * LEAF, mid * LEAF, min(hi * LEAF, size)
        seed = int.from_bytes(hashlib.md5(f"{key}:{lo}-{hi}".encode()).digest(), "little")
        left = int(np.random.Generator(np.random.Philox(seed)).binomial(k, (cut - first) / (last - first)))
        if leaf < mid:
            k, hi = left, mid
        else:
            k, lo = k - left, mid
    return k


def _md5_heads(openings: list[bytes], counts: list[int]) -> np.ndarray:
    """The first four bytes, as one number each, of the MD5 of each opening followed by 0, 1, ... count - 1."""
    count, digits, begin = sum(counts), len(str(max(counts))), len(openings[0])
    if not count or begin + digits > 55 or any(len(opening) != begin for opening in openings):
        # Texts of different shapes, or of more than one block of MD5.
        found = (hashlib.md5(o + str(slot).encode()).digest()[:4] for o, n in zip(openings, counts) for slot in range(n))
        return np.frombuffer(b"".join(found), ">u4").astype(np.uint32)
    slots = np.arange(max(counts))
    tail = np.zeros((len(slots), 64 - begin), np.uint8)
    for size in range(1, digits + 1):
        rows = slots[10 ** (size - 1) if size > 1 else 0 : 10**size]
        for place in range(size):
            tail[rows, place] = 48 + rows // 10 ** (size - 1 - place) % 10
        tail[rows, size] = 0x80
        tail[rows, 56 - begin : 58 - begin] = np.frombuffer((8 * (begin + size)).to_bytes(2, "little"), np.uint8)
    text = np.empty((count, 64), np.uint8)
    for opening, end, n in zip(openings, np.cumsum(counts), counts):
        text[end - n : end, :begin] = np.frombuffer(opening, np.uint8)
        text[end - n : end, begin:] = tail[:n]
    words = np.ascontiguousarray(text.view("<u4").T)
    # A word that all rows share is one number, added to the constant of its round.
    same = [(word == word[0]).all() for word in words]
    a, b, c, d = (np.full(count, x, np.uint32) for x in MD5_START)
    spare, other = np.empty_like(a), np.empty_like(a)
    for number, (constant, turn) in enumerate(zip(MD5_CONSTANTS, MD5_TURNS)):
        part, at = divmod(number, 16)
        at = (at, (5 * at + 1) % 16, (3 * at + 5) % 16, 7 * at % 16)[part]
        if part == 2:
            np.bitwise_xor(b, c, out=spare)
            np.bitwise_xor(spare, d, out=spare)
        elif part == 3:
            np.invert(d, out=spare)
            np.bitwise_or(spare, b, out=spare)
            np.bitwise_xor(spare, c, out=spare)
        else:
            x, y, z = (b, c, d) if part == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=spare)
            np.bitwise_and(spare, x, out=spare)
            np.bitwise_xor(spare, z, out=spare)
        np.add(spare, a, out=spare)
        if same[at]:
            np.add(spare, np.uint32((constant + int(words[at][0])) & 0xFFFFFFFF), out=spare)
        else:
            np.add(spare, words[at], out=spare)
            np.add(spare, np.uint32(constant), out=spare)
        np.left_shift(spare, np.uint32(turn), out=other)
        np.right_shift(spare, np.uint32(32 - turn), out=spare)
        np.bitwise_or(spare, other, out=spare)
        np.add(spare, b, out=spare)
        a, d, c, b, spare = d, c, b, spare, a
    return (a + np.uint32(MD5_START[0])).byteswap()


def leaf_weights(seed: int, replicates: range, stratum: str, size: int, leaf: int) -> np.ndarray:
    """How often each replicate drew each cluster of a leaf: replicates by positions in the leaf."""
    leaves = -(-size // LEAF)
    here = min(LEAF, size - leaf * LEAF)
    out = np.empty((len(replicates), here))
    # A stratum of one leaf needs no leaf in its name.
    place = stratum if leaves == 1 else f"{stratum}/{leaf}"
    for first in range(0, len(replicates), TOGETHER):
        some = replicates[first : first + TOGETHER]
        counts = [_leaf_draws(size, 0, leaves, leaf, size, f"{seed}:{replicate}:{stratum}") for replicate in some]
        heads = _md5_heads([f"{seed}:{replicate}:{place}:".encode() for replicate in some], counts)
        drawn = np.repeat(np.arange(len(some)) * here, counts) + heads % np.uint32(here)
        out[first : first + len(some)] = np.bincount(drawn, minlength=len(some) * here).reshape(-1, here)
    return out


def _placed(clusters: DataFrame, resamples: int) -> DataFrame:
    """``clusters`` with their position, the size of their stratum, and their leaf."""
    if resamples < 1:
        raise ValueError(f"resamples must be positive, got {resamples}")
    sizes = clusters.groupBy("stratum").agg(F.count("*").alias("_size"))
    return numbered_clusters(clusters).join(sizes, "stratum").withColumn("_leaf", F.floor(F.col("position") / LEAF))


def _leaves(clusters: DataFrame, resamples: int) -> DataFrame:
    """``clusters`` with the size of their stratum, their leaf, and once for each range of replicates."""
    return _dealt(_placed(clusters, resamples), range(RANGES))


def _dealt(placed: DataFrame, ranges: range) -> DataFrame:
    """Placed clusters once for each of some ranges of replicates, dealt by leaf."""
    dealt = placed.withColumn("_range", F.explode(F.sequence(F.lit(ranges[0]), F.lit(ranges[-1]))))
    # A leaf is few bytes and many draws: adaptive execution, which sees bytes only, is not to join leaves into few tasks.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return dealt.repartition(tasks, "stratum", "_size", "_leaf", "_range")


def _range_of(number: int, resamples: int) -> list[range]:
    """The replicates of a range in chunks; chunks begin at multiples of ``CHUNK``."""
    chunks = range(number, -(-resamples // CHUNK), RANGES)
    return [range(c * CHUNK, min((c + 1) * CHUNK, resamples)) for c in chunks]


@dataclass(frozen=True)
class UserAggregate:
    """A statistic of a replicate as states that can be made apart and merged.

    ``update`` gets a leaf's clusters (one row each) and the weights (replicates by those rows), and
    returns a state, a row of numbers, for each replicate. ``merge`` joins two tables of states
    and must not depend on order; ``finish`` turns the state of all clusters into the value.
    """

    update: Callable[[pd.DataFrame, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


def _partial_states(clusters: DataFrame, update: Callable[[pd.DataFrame, np.ndarray], np.ndarray], resamples: int, seed: int) -> DataFrame:
    """(replicate, leaf, state): one row for each leaf of clusters and replicate."""

    def add(key: tuple, leaf: pa.Table) -> pa.Table:
        stratum, size, number, part = (k.as_py() for k in key)
        rows = leaf.sort_by("position").to_pandas()
        found = [(r, update(rows, leaf_weights(seed, r, stratum, size, number))) for r in _range_of(part, resamples)]
        states = np.concatenate([np.asarray(f[1], np.float64) for f in found]) if found else np.zeros((0, 1))
        replicate = np.concatenate([np.asarray(f[0], np.int64) for f in found]) if found else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1) * states.shape[1], pa.int32()), pa.array(states.ravel()))
        leaves = pa.array(np.full(len(states), number), pa.int64())
        return pa.table({"replicate": replicate, "leaf": leaves, "state": lists})

    return _leaves(clusters, resamples).groupBy("stratum", "_size", "_leaf", "_range").applyInArrow(
        add, "replicate long, leaf long, state array<double>"
    )


def _merged(states: DataFrame, by: list[str], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``states`` with one state for each key."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        whole = reduce(merge, (np.asarray(s.as_py(), np.float64) for s in rows.column("state")))
        values = [pa.array([k.as_py()], pa.int64()) for k in key]
        return pa.table([*values, pa.array([whole.tolist()], pa.list_(pa.float64()))], [*by, "state"])

    return states.groupBy(*by).applyInArrow(join, ", ".join(f"{c} long" for c in by) + ", state array<double>")


def _stratum(strata: str | None) -> Column:
    return F.col(strata).cast("string") if strata else F.lit("all")


def split_clusters(cases: DataFrame, cluster: str, strata: str) -> DataFrame:
    """Clusters that lie in more than one stratum, which a stratified bootstrap cannot draw."""
    return (
        cases.groupBy(F.col(cluster).alias("cluster"))
        .agg(F.count_distinct(strata).alias("strata"))
        .where(F.col("strata") > 1)
    )


def mean_replicates_of(
    cases: DataFrame,
    values: list[str],
    cluster: str,
    strata: str | None = None,
    resamples: int = S.RESAMPLES,
    seed: int = S.REPORT_SEED,
) -> DataFrame:
    """(replicate, one column per value): the means over the rows of each replicate, from cluster
    sums and sizes. All values share the draws."""
    totals = [F.sum(F.col(v).cast("double")).alias(f"_total_{v}") for v in values]
    # One row per cluster, written once: numbering and drawing both read it.
    by_cluster = cases.groupBy(_stratum(strata).alias("stratum"), F.col(cluster).alias("cluster")).agg(
        *totals, F.count("*").alias("_rows")
    )
    drawn = sum_replicates(by_cluster, [f"_total_{v}" for v in values] + ["_rows"], resamples, seed)
    return drawn.select("replicate", *[(F.col(f"_total_{v}") / F.col("_rows")).alias(v) for v in values])


def sum_replicates(clusters: DataFrame, names: list[str], resamples: int = S.RESAMPLES, seed: int = S.REPORT_SEED) -> DataFrame:
    """(replicate, one column per name): the sums over the drawn clusters of ``clusters`` (stratum,
    cluster, names). A null counts nothing."""
    table = clusters.select("stratum", "cluster", *[F.col(n).cast("double").alias(n) for n in names]).na.fill(0.0, names)

    def update(rows: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
        return weights @ rows[names].to_numpy()

    parts = _partial_states(materialize(table, "cluster-sums"), update, resamples, seed)
    return parts.groupBy("replicate").agg(*[F.sum(F.get("state", F.lit(i))).alias(n) for i, n in enumerate(names)])


def mean_replicates(
    cases: DataFrame,
    value: str,
    cluster: str,
    strata: str | None = None,
    resamples: int = S.RESAMPLES,
    seed: int = S.REPORT_SEED,
) -> DataFrame:
    """(replicate, value) of one mean."""
    replicates = mean_replicates_of(cases, [value], cluster, strata, resamples, seed)
    return replicates.withColumnRenamed(value, "value")


def intervals(replicates: DataFrame, values: list[str], confidence: float = S.CONFIDENCE) -> DataFrame:
    """One row with <value>_low, <value>_high and <value>_mde for several always-defined values."""
    check_confidence(confidence)
    alpha = 1.0 - confidence
    ends = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    row = replicates.agg(
        *[F.percentile(v, ends).alias(f"_ends_{v}") for v in values],
        *[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"_se_{v}") for v in values],
    )
    columns = []
    for v in values:
        columns += [
            F.get(f"_ends_{v}", F.lit(0)).alias(f"{v}_low"),
            F.get(f"_ends_{v}", F.lit(1)).alias(f"{v}_high"),
            (F.col(f"_se_{v}") * effect_factor(confidence)).alias(f"{v}_mde"),
        ]
    return row.select(*columns)


def interval(replicates: DataFrame, confidence: float = S.CONFIDENCE) -> DataFrame:
    """One row: percentile interval, standard error, undefined share and the smallest effect the
    replicates could show. The interval is null when more than one in a hundred is undefined."""
    check_confidence(confidence)
    alpha = 1.0 - confidence
    value = F.col("value")
    defined = F.when(value.isNotNull() & ~F.isnan(value), value)
    row = replicates.agg(
        F.percentile(defined, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ends"),
        F.coalesce(F.stddev_samp(defined), F.lit(0.0)).alias("standard_error"),
        F.count("*").alias("replicates"),
        F.count_if(defined.isNull()).alias("undefined"),
    )
    sound = F.col("undefined") <= S.MAX_UNDEFINED_SHARE * F.col("replicates")
    return row.select(
        F.when(sound, F.get("_ends", F.lit(0))).alias("low"),
        F.when(sound, F.get("_ends", F.lit(1))).alias("high"),
        "standard_error",
        (F.col("standard_error") * effect_factor(confidence)).alias("mde"),
        "replicates",
        "undefined",
    )


def bootstrap_mean(
    cases: DataFrame,
    value: str,
    cluster: str,
    strata: str | None = None,
    resamples: int = S.RESAMPLES,
    confidence: float = S.CONFIDENCE,
    seed: int = S.REPORT_SEED,
) -> DataFrame:
    """Point, interval and smallest detectable effect of a mean of per-row values."""
    point = cases.agg(F.avg(F.col(value).cast("double")).alias("point"))
    replicates = mean_replicates(cases, value, cluster, strata, resamples, seed)
    return point.crossJoin(F.broadcast(interval(replicates, confidence)))


def auroc_replicates(
    cases: DataFrame,
    score: str,
    label: str,
    cluster: str,
    strata: str | None = None,
    resamples: int = S.RESAMPLES,
    seed: int = S.REPORT_SEED,
) -> DataFrame:
    """(replicate, value): the AUROC of each replicate, null where it drew one class only.

    Scores are cut into ordered buckets and replicates into ranges. For one bucket and range a task
    multiplies the weights of the clusters (clusters by replicates) with the bucket's histogram, slice by slice, and
    gives one row per replicate: its positives, negatives and ordered pairs inside the bucket. The
    pairs between buckets follow from those rows. A weight is a byte and goes once to each bucket that has its
    cluster, a histogram row once to each range; no pair of clusters is formed. Ranges are worked on in passes, one
    after the other, and what a pass moved is gone when the next begins. So the disk holds ``PASS_BYTES`` or so, or one range.
    """
    positive = F.col(label).cast("int")
    hist = cases.groupBy(
        _stratum(strata).alias("stratum"), F.col(cluster).alias("cluster"), F.col(score).alias("score")
    ).agg(F.sum(positive).cast("long").alias("pos"), F.sum(1 - positive).cast("long").alias("neg"))
    spark = cases.sparkSession
    hist = materialize(hist, "cluster-histograms")
    clusters = materialize(_placed(hist.select("stratum", "cluster").distinct(), resamples), "placed-clusters")

    def pack(key: tuple, leaf: pa.Table) -> pa.Table:
        stratum, size, number, part = (k.as_py() for k in key)
        at = leaf.column("position").to_numpy() - number * LEAF
        drawn = [leaf_weights(seed, r, stratum, size, number).T[at] for r in _range_of(part, resamples)]
        if not drawn:
            return nothing
        whole = np.concatenate(drawn, axis=1)
        rows = [row.tobytes() for row in whole.astype(np.uint8 if whole.max() < 256 else np.uint32)]
        ranges = pa.array(np.full(len(at), part), pa.int32())
        columns = [ranges, leaf.column("stratum").combine_chunks(), leaf.column("cluster").combine_chunks(), pa.array(rows, pa.binary())]
        return pa.table(columns, ["range", "stratum", "cluster", "weights"])

    kind = hist.schema["cluster"].dataType
    nothing = pa.table(
        [pa.array([], t) for t in (pa.int32(), pa.string(), to_arrow_type(kind), pa.binary())], ["range", "stratum", "cluster", "weights"]
    )
    buckets = min(MAX_BUCKETS, -(-hist.count() // BUCKET_ROWS)) or 1
    placed = materialize(with_bucket(hist.where("score is not null"), "score", buckets), "bucketed-histograms")
    present = materialize(placed.select("_bucket", "stratum", "cluster").distinct(), "present")
    used = min(RANGES, -(-resamples // CHUNK))
    moved = HIST_BYTES * placed.count() + (KEY_BYTES + -(-resamples // used)) * (present.count() + clusters.count())
    passes = _passes(used, moved)

    def products(ranges: range) -> DataFrame:
        packed = _dealt(clusters, ranges).groupBy("stratum", "_size", "_leaf", "_range").applyInArrow(
            pack, f"range int, stratum string, cluster {kind.simpleString()}, weights binary"
        )
        # A cluster's draws in one range of replicates are one row.
        packed = materialize(packed, "weights")
        drawn = packed.join(present, ["stratum", "cluster"]).select("range", F.col("_bucket").alias("bucket"), _member(), "weights")
        each = F.explode(F.sequence(F.lit(ranges[0]), F.lit(ranges[-1]))).alias("range")
        asked = placed.select(each, F.col("_bucket").alias("bucket"), _member(), F.col("score").cast("double").alias("score"), "pos", "neg")
        return asked.groupBy("range", "bucket").cogroup(drawn.groupBy("range", "bucket")).applyInArrow(
            partial(_bucket_products, resamples), "replicate long, bucket int, pos double, neg double, inside double"
        )

    if len(passes) == 1:
        parts = products(passes[0])
    else:
        made = []
        for ranges in passes:
            with temporary(spark) as keep:
                made.append(keep(products(ranges), "products"))
        parts = reduce(DataFrame.union, made)
    before = Window.partitionBy("replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    total = parts.withColumn("pairs", F.col("inside") + F.col("pos") * below).groupBy("replicate").agg(
        F.sum("pairs").alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return total.select("replicate", F.when(both, F.col("pairs") / (F.col("pos") * F.col("neg"))).alias("value"))


def _passes(used: int, moved: int) -> list[range]:
    """The first ``used`` ranges of replicates in passes, of which a range moves so many bytes."""
    wide = max(1, min(used, PASS_BYTES // max(moved, 1)))
    return [range(first, min(first + wide, used)) for first in range(0, used, wide)]


def _member() -> Column:
    return F.concat_ws("|", "stratum", F.col("cluster").cast("string")).alias("member")


def _bucket_products(resamples: int, key: tuple, asked: pa.Table, drawn: pa.Table) -> pa.Table:
    """One bucket's positives, negatives and ordered pairs (ties count half) of each replicate of a range."""
    replicates = np.concatenate([np.asarray(r, np.int64) for r in _range_of(key[0].as_py(), resamples)])
    # The last row stands for a cluster that was not drawn from.
    matrix = np.zeros((drawn.num_rows + 1, len(replicates)), np.uint8)
    for number, weights in enumerate(drawn.column("weights")):
        raw = weights.as_buffer()
        row = np.frombuffer(raw, np.uint8 if raw.size == len(replicates) else np.uint32)
        if row.dtype != matrix.dtype and row.max() > np.iinfo(matrix.dtype).max:
            matrix = matrix.astype(np.uint32)
        matrix[number] = row
    member = pc.index_in(asked.column("member"), drawn.column("member").combine_chunks())
    row = pc.fill_null(member, drawn.num_rows).to_numpy().astype(np.int64)
    score, pos, neg = (asked.column(n).to_numpy() for n in ("score", "pos", "neg"))
    order = np.argsort(score, kind="stable")
    score, pos, neg, row = score[order], pos[order].astype(np.float64), neg[order].astype(np.float64), row[order]
    inside, all_pos, below = (np.zeros(len(replicates)) for _ in range(3))
    # Of the last score met: its rows may go on in the next slice.
    open_pos, open_neg, last = np.zeros(len(replicates)), np.zeros(len(replicates)), None
    for begin in range(0, len(order), SLICE_ROWS):
        some = slice(begin, begin + SLICE_ROWS)
        first = np.flatnonzero(np.append(True, np.diff(score[some]) != 0))
        weights = matrix[row[some]].astype(np.float64)
        p = np.add.reduceat(weights * pos[some, None], first, axis=0)
        n = np.add.reduceat(weights * neg[some, None], first, axis=0)
        if score[begin] == last:
            p[0] += open_pos
            n[0] += open_neg
        else:
            inside += open_pos * (below + open_neg / 2)
            all_pos, below = all_pos + open_pos, below + open_neg
        open_pos, open_neg, last = p[-1], n[-1], score[some][-1]
        p, n = p[:-1], n[:-1]
        inside += (p * (below + np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
        all_pos, below = all_pos + p.sum(axis=0), below + n.sum(axis=0)
    inside += open_pos * (below + open_neg / 2)
    return pa.table(
        {
            "replicate": replicates,
            "bucket": np.full(len(replicates), key[1].as_py(), dtype=np.int32),
            "pos": all_pos + open_pos,
            "neg": below + open_neg,
            "inside": inside,
        }
    )


def auroc_difference_replicates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Replicates of a difference; both sides drew the same clusters from the same seed."""
    other = second.select("replicate", F.col("value").alias("_other"))
    return first.join(other, "replicate").select(
        "replicate", (F.col("value") - F.col("_other")).alias("value")
    )


def cluster_bootstrap(
    cases: DataFrame,
    statistic: UserAggregate,
    cluster: str,
    strata: str | None = None,
    resamples: int = S.RESAMPLES,
    seed: int = S.REPORT_SEED,
) -> DataFrame:
    """(replicate, value) of a user's statistic.

    ``cases`` holds one row per cluster: its sufficient statistics, already aggregated. States of leaves
    are merged in groups first and then in all, so no task holds a cluster table, and
    what is shuffled is leaves times replicates.
    """
    named = cases.select("*", _stratum(strata).alias("stratum")) if strata != "stratum" else cases
    if cluster != "cluster":
        named = named.withColumnRenamed(cluster, "cluster")
    parts = _partial_states(materialize(named, "clusters"), statistic.update, resamples, seed)
    some = _merged(parts.withColumn("leaf", F.pmod("leaf", F.lit(MERGED)).cast("long")), ["replicate", "leaf"], statistic.merge)
    whole = _merged(some, ["replicate"], statistic.merge)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [float(statistic.finish(np.asarray(s.as_py(), np.float64))) for s in batch.column("state")]
            yield pa.RecordBatch.from_arrays([batch.column("replicate"), pa.array(value, pa.float64())], ["replicate", "value"])

    return whole.mapInArrow(finish, "replicate long, value double")

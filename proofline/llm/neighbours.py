"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by halving it again and again, so their lists have like
sizes. A vector is posted to its nearest centroid and, if it lies near a boundary, to others whose
distance is within a ratio of the nearest. Centroids are found by a beam search over a graph of
them, held in memory by every task. A query reads the lists whose centroids are within a ratio of
the nearest one's distance, and the scores of what it reads are exact.

Equal vectors are one entry with their smallest ids, since no other of them can be among the
nearest few; so a vector that a third of all rows share is one posting. Lists and the queries of a
list are cut into blocks, and pairs of blocks are multiplied, so no task holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.session import materialize

#: Vectors the centroids are fitted on (about), and most centroids; else there are as many as the
#: square root of the entries, so that lists are about as long as there are lists.
SAMPLE, MOST_CENTROIDS = 20_000, 2048
#: Neighbours of a centroid in the graph, and beam of the search when vectors are posted.
DEGREE, BEAM = 16, 32
#: Replicas: lists at most this many times as far as the nearest, and how many at most.
BOUNDARY_RATIO, REPLICAS = 1.15, 4
#: Lists read: centroids at most this many times as far as the nearest, at least so many; the beam of
#: queries is a share of all lists, so the ratio decides and not the beam.
SEARCH_RATIO, LEAST_LISTS, BEAM_SHARE = 1.4, 32, 0.25
#: Entries of a block, on average.
BLOCK = 512


@dataclass(frozen=True)
class Index:
    """Unit centroids, their graph, and the centroids a search starts from."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the centroids found near each unit vector, nearest first."""
        count, beam = len(vectors), min(beam, len(self.centroids))
        rows = np.arange(count)[:, None]
        seen = np.zeros((count, len(self.centroids)), dtype=bool)
        seen[:, self.entries] = True
        width = max(beam, len(self.entries))
        near = np.full((count, width), -1, dtype=np.int64)
        cosine = np.full((count, width), -np.inf)
        near[:, : len(self.entries)] = self.entries
        cosine[:, : len(self.entries)] = vectors @ self.centroids[self.entries].T
        open_ = near >= 0
        order = np.argsort(-cosine, axis=1, kind="stable")[:, :beam]
        near, cosine, open_ = near[rows, order], cosine[rows, order], open_[rows, order]
        live = np.arange(count)
        while len(live):
            # Of each query still searching, the nearest centroid not yet expanded.
            at = np.argmax(open_[live], axis=1)
            going = open_[live, at]
            live, at = live[going], at[going]
            if not len(live):
                break
            open_[live, at] = False
            others = self.graph[near[live, at]]
            fresh = ~seen[live[:, None], others]
            seen[live[:, None], others] = True
            value = np.where(fresh, np.einsum("qgd,qd->qg", self.centroids[others], vectors[live]), -np.inf)
            all_near = np.concatenate([near[live], others], axis=1)
            all_cosine = np.concatenate([cosine[live], value], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            order = np.argsort(-all_cosine, axis=1, kind="stable")[:, :beam]
            pick = np.arange(len(live))[:, None]
            near[live], cosine[live], open_[live] = all_near[pick, order], all_cosine[pick, order], all_open[pick, order]
        return near, np.sqrt(np.maximum(2 - 2 * cosine, 0))


def fit_index(sample: np.ndarray, lists: int) -> Index:
    """Centroids of equal shares of the unit vectors of ``sample``, and their graph."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists and min(len(p) for p in parts) >= 2:
        halves = []
        for part in parts:
            rows = sample[part]
            away = rows - rows.mean(axis=0)
            # The main direction, by a few power steps from the farthest point.
            way = away[np.argmax((away**2).sum(axis=1))]
            for _ in range(6):
                way = away.T @ (away @ way)
                way /= np.linalg.norm(way) or 1.0
            order = np.argsort(away @ way, kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = halves
    centroids = np.array([sample[p].mean(axis=0) for p in parts])
    length = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = np.where(length > 0, centroids / np.where(length > 0, length, 1), sample[[p[0] for p in parts]])
    cosine = centroids @ centroids.T
    np.fill_diagonal(cosine, -np.inf)
    degree = min(DEGREE, len(parts))
    nearest = np.argsort(-cosine, axis=1)[:, :degree]
    # Half as many links lead far away, so that no part of the graph is cut off.
    far = (np.arange(len(parts))[:, None] + (len(parts) * np.arange(1, degree // 2 + 1)) // (degree // 2 + 1)) % len(parts)
    entries = np.unique(np.linspace(0, len(parts) - 1, max(1, int(len(parts) ** 0.5))).astype(np.int64))
    graph = np.sort(np.concatenate([nearest, far], axis=1), axis=1)
    # A neighbour met twice would stand twice in the beam; the centroid itself is always seen.
    again = np.zeros(graph.shape, dtype=bool)
    again[:, 1:] = graph[:, 1:] == graph[:, :-1]
    return Index(centroids, np.where(again, np.arange(len(parts))[:, None], graph), entries)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _posted(batches: Iterator[pa.RecordBatch], index, beam: int, ratio: float, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """(list, row) for every list a vector belongs to or reads, with the vector."""
    for batch in batches:
        for begin in range(0, len(batch), 512):
            part = batch.slice(begin, 512)
            near, away = index.value.search(_unit(_matrix(part.column("vector"))), beam)
            chosen = (away <= ratio * away[:, :1]) | (np.arange(near.shape[1]) < least)
            chosen[:, most:] = False
            row, place = np.nonzero(chosen & (near >= 0))
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(near[row, place].astype(np.int32)), *taken.columns], ["list", *part.schema.names])


def _block_scores(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """The best entries of a block of postings for each query of a block."""
    for batch in batches:
        for pair in range(len(batch)):
            queries, entries = (batch.column(n)[pair].values for n in ("queries", "entries"))
            q, e = (_matrix(x.field("vector")) for x in (queries, entries))
            cosine = _unit(q) @ _unit(e).T
            count = min(keep, cosine.shape[1])
            # Ties at the cut are all kept; the exact score and the ids decide later.
            cut = -np.partition(-cosine, count - 1, axis=1)[:, count - 1]
            row, place = np.nonzero(cosine >= cut[:, None] - 1e-12)
            a, b = q[row], e[place]
            scale_a, scale_b = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
            a, b = a / scale_a[:, None], b / scale_b[:, None]
            dot = np.einsum("ij,ij->i", a, b)
            score = dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            yield pa.RecordBatch.from_arrays(
                [queries.field("key").take(pa.array(row)), pa.array(score), entries.field("ids").take(pa.array(place))],
                ["key", "score", "ids"],
            )


@contextmanager
def _small_batches(spark: SparkSession, records: int) -> Iterator[None]:
    """Blocks are large values, so fewer of them go to Python at once while a step runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def usable(column: str = "embedding") -> Column:
    """Whether a vector has only finite components and is not zero."""
    value = F.col(column).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _blocks(posted: DataFrame, lists: int, content: list[str], name: str) -> DataFrame:
    """Lists cut into blocks of about BLOCK entries by hash; sizes are one row per list."""
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    parts = np.ones(lists, dtype=np.int64)
    for row in sizes:
        parts[row["list"]] = -(-row["n"] // BLOCK)
    number = F.get(F.lit([int(x) for x in parts]), F.col("list"))
    block = F.pmod(F.xxhash64("key"), number)
    return posted.groupBy("list", block.alias("block")).agg(F.collect_list(F.struct(*content)).alias(name)).drop("block")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each row of
    ``queries`` (both: vec_id, embedding), by cosine, never the query's own id; ties go to the
    smaller vec_id, and with fewer than k other rows all are returned.

    Vectors that are null, zero or hold null or non-finite components take no part, neither do rows
    without an id and vectors of another length than most have; repeated rows count once. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    kinds = [
        table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
        .where(usable("vector") & F.col("id").isNotNull())
        for table in (vectors, queries)
    ]
    longest = kinds[0].groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (table.where(F.size("vector") == longest["size"]).distinct() for table in kinds)

    order = Window.partitionBy("vector").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entries = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries.select(F.get("ids", F.lit(0)).alias("key"), "ids", "vector"), "entries")
    count = entries.count()

    share = min(1.0, SAMPLE / count)
    drawn = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    sample = _unit(_matrix(entries.where(drawn).orderBy("key").select("vector").toArrow().column("vector").combine_chunks()))
    wanted = max(1, min(MOST_CENTROIDS, int(count**0.5)))
    index = spark.sparkContext.broadcast(fit_index(sample, wanted))
    lists = len(index.value.centroids)
    beam = max(2 * LEAST_LISTS, int(lists * BEAM_SHARE))

    posted = entries.mapInArrow(
        partial(_posted, index=index, beam=BEAM, ratio=BOUNDARY_RATIO, least=1, most=REPLICAS), "list int, key long, ids array<long>, vector array<double>"
    )
    posted = materialize(posted, "postings")
    asked = materialize(asked, "queries")
    distinct = asked.groupBy("vector").agg(F.min("id").alias("key"))
    read = distinct.select("key", "vector").mapInArrow(
        partial(_posted, index=index, beam=beam, ratio=SEARCH_RATIO, least=LEAST_LISTS, most=lists), "list int, key long, vector array<double>"
    )
    read = materialize(read, "reads")
    pairs = _blocks(read, lists, ["key", "vector"], "queries").join(_blocks(posted, lists, ["key", "ids", "vector"], "entries"), "list")
    with _small_batches(spark, 8):
        scored = materialize(
            pairs.select("queries", "entries").mapInArrow(partial(_block_scores, keep=k + 1), "key long, score double, ids array<long>"), "scores"
        )
    # A vector posted to two lists comes twice with one score.
    single = scored.select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = single.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    keyed = asked.join(distinct, "vector").select(F.col("id").alias("query_id"), "key")
    found = keyed.join(top, "key").where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

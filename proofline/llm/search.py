"""Ranked lexical search by pipelined term partitioning.

The terms of the searched items are dealt to owners, the rarest terms to the first. An item bundle is a
set of items with their accumulators for one slice of the documents: sparse (item, document, score)
entries. It visits the owners one after the other; at each it is cogrouped with the owner's postings
of that slice, adds the integer contributions of the terms its items hold, and is passed on. After the last owner
the best documents of each item and slice are taken, and of these the best of all.

Everything is bounded by the slice (a few megabytes of text) and the bundle (a number of items): no
list of a term is gathered beyond a slice, and no accumulator table of all documents exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.llm.arrays import LOWER, NOT_WORD, ranges, text_slices, word_bounds
from proofline.llm.decontamination import _filter_bits, _may_have, word_hashes
from proofline.session import materialize

BEST = 50
#: Owners that a bundle visits, and about so many items in a bundle.
OWNERS, BUNDLE_ITEMS = 3, 256
#: Bytes of text and documents of a slice.
SLICE, SLICE_ROWS = 1 << 22, 4096
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Accumulators = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), F.lit(f"({TERM})"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each. Texts of one id are one item."""
    return items.select(
        F.col("item_id").alias("item_id"), F.explode(terms_of(F.col("text").cast("string"))).alias("term")
    ).distinct()


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("term")):
            hashes = word_hashes(data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["print"])


def _slice_batches(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """One row a slice: its documents (id, terms with repeats) and the postings of terms that may be
    asked for: terms, how many postings each has, and their places and occurrences."""
    filter_bits = np.frombuffer(bits.value, np.uint8)
    parts = (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))
    for batch in parts:
        ids = batch.column("doc_id")
        for first, last, data, offsets in text_slices(batch.column("text"), SLICE):
            low = LOWER[data]
            starts, ends, counts = word_bounds(low, offsets, NOT_WORD)
            row = np.repeat(np.arange(len(counts)), counts)
            asked = _may_have(filter_bits, word_hashes(low, starts, ends)) if len(starts) else np.zeros(0, bool)
            starts, sizes, row = starts[asked], (ends - starts)[asked], row[asked]
            places = np.append(0, np.cumsum(sizes)).astype(np.int32)
            words = pa.StringArray.from_buffers(
                len(sizes), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(low[ranges(starts, sizes)]))
            ).dictionary_encode()
            posting, times = np.unique(words.indices.to_numpy().astype(np.int64) * len(counts) + row, return_counts=True)
            listed = np.bincount(posting // max(len(counts), 1), minlength=len(words.dictionary))
            columns = [
                ids.slice(first, last - first), pa.array(counts, pa.int64()), words.dictionary, pa.array(listed, pa.int32()),
                pa.array(posting % max(len(counts), 1), pa.int32()), pa.array(times, pa.int32()),
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays(lists, ["ids", "lengths", "terms", "listed", "places", "times"])


def _posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of slices by term: slice, term, places, times."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms, listed, places, times = (batch.column(c)[i].values for c in ("terms", "listed", "places", "times"))
            offsets = pa.array(np.append(0, np.cumsum(listed.to_numpy())), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (places, times)]
            slices = pa.array(np.full(len(terms), batch.column("slice")[i].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([slices, terms, *lists], ["slice", "term", "places", "times"])


def measures(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Twenty times m of each document, from its number of terms."""
    return np.array([20 * (50 + 50 * int(n) * documents // terms) for n in lengths], dtype=np.int64)


def added(known: Accumulators, postings: pa.Table, documents: int, measure: np.ndarray) -> Accumulators:
    """Accumulators (item, place, score) with the contributions of postings, each with the items asking for its term."""
    columns = [postings.column(c).combine_chunks() for c in ("items", "places", "times")]
    asking, place, times = (c.flatten().to_numpy().astype(np.int64) for c in columns)
    item_at, place_at = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in columns[:2])
    value = 1_000_000_000 * times // (1000 * times + measure[place])
    value *= np.repeat(postings.column("weight").to_numpy(), np.diff(place_at))
    # Every posting of a term goes to every item that asks for it.
    per_item = np.repeat(np.diff(place_at), np.diff(item_at))
    at = ranges(np.repeat(place_at[:-1], np.diff(item_at)), per_item)
    item = np.append(known[0], np.repeat(asking, per_item))
    key = item * documents + np.append(known[1], place[at])
    total = np.zeros(documents * (int(item.max(initial=0)) + 1), dtype=np.int64)
    np.add.at(total, key, np.append(known[2], value[at]))
    met = np.flatnonzero(total)
    return met // max(documents, 1), met % max(documents, 1), total[met]


def _best(known: Accumulators, ids: list[int | None], count: int) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """The best documents of each item of one slice."""
    item, place, score = (x[known[2] > 0] for x in known)
    # Without an id comes last among equal scores.
    order_of = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], dtype=np.int64)
    order = np.lexsort((order_of[place], -score, item))
    item, place, score = item[order], place[order], score[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    kept = rank < count
    return item[kept], [ids[p] for p in place[kept]], score[kept]


def _visit(state: pa.Table, postings: pa.Table, last: bool, documents: int, terms: int, best: int) -> pa.Table:
    """One bundle at one owner; after the last owner its best documents."""
    row = {c: state.column(c).combine_chunks() for c in state.column_names}
    ids, lengths = row["ids"].flatten(), row["lengths"].flatten().to_numpy()
    known = tuple(row[c].flatten().to_numpy().astype(np.int64) for c in ("items", "places", "scores"))
    if postings.num_rows:
        known = added(known, postings, len(lengths), measures(lengths, documents, terms))
    if last:
        item, found, score = _best(known, ids.to_pylist(), best)
        return pa.table(
            {
                "bundle": pa.array(np.full(len(item), row["bundle"][0].as_py(), dtype=np.int32)),
                "item": pa.array(item, pa.int32()),
                "doc_id": pa.array(found, pa.int64()),
                "score": pa.array(score, pa.int64()),
            }
        )
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(known, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
    return pa.table({"bundle": row["bundle"], "slice": row["slice"], "ids": row["ids"], "lengths": row["lengths"], "items": lists[0], "places": lists[1], "scores": lists[2]})


def _visitor(last: bool, documents: int, terms: int, best: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def visit(state: pa.Table, postings: pa.Table) -> pa.Table:
        return _visit(state, postings, last, documents, terms, best)

    return visit


STATE = "bundle int, slice long, ids array<long>, lengths array<long>, items array<int>, places array<int>, scores array<long>"


def search(docs: DataFrame, items: DataFrame, best: int = BEST, owners: int = OWNERS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item with a score above zero.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts have no terms; texts of one
    item_id are one item, and a null item_id is an item too. Repeated documents are ranked each;
    of equal scores the smaller doc_id comes first, and rows without an id last. Items without terms
    and empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items), "item-terms")
    prints = asked.select("term").distinct().mapInArrow(_print_batches, "print long")
    bits = spark.sparkContext.broadcast(_filter_bits(prints))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "ids array<long>, lengths array<long>, terms array<string>, listed array<int>, places array<int>, times array<int>"
    slices = narrow.mapInArrow(partial(_slice_batches, bits=bits), schema)
    slices = materialize(slices.withColumn("slice", F.monotonically_increasing_id()), "slices")
    lengths = slices.select(F.explode("lengths").alias("n"))
    documents, terms = lengths.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()

    # Items are numbered inside their bundle; a term's owner follows its weight.
    held = slices.select(F.explode(F.arrays_zip("terms", "listed")).alias("t")).groupBy(F.col("t.terms").alias("term"))
    df = held.agg(F.sum("t.listed").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents + 2.0)) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = materialize(df.join(asked.select("term").distinct(), "term", "left_semi").select("term", weight.alias("weight")), "term-weights")
    bounds = weighed.agg(F.percentile_approx("weight", F.array(*[F.lit(i / owners) for i in range(1, owners)]), F.lit(1000))).head()[0] if owners > 1 else []
    owner = sum((F.when(F.col("weight") < b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    bundles = -(-asked.select("item_id").distinct().count() // BUNDLE_ITEMS) or 1
    numbered = asked.select("item_id").distinct().withColumn("bundle", F.pmod(F.hash("item_id"), F.lit(bundles)))
    numbered = materialize(numbered.withColumn("item", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1), "items")
    same = asked.item_id.eqNullSafe(numbered.item_id)
    wanted = asked.join(numbered, same).select("term", "bundle", "item").join(weighed.withColumn("owner", owner), "term")
    wanted = materialize(wanted.groupBy("owner", "term", "weight", "bundle").agg(F.array_sort(F.collect_list("item")).alias("items")), "wanted")

    postings = slices.select("slice", "terms", "listed", "places", "times").mapInArrow(
        _posting_batches, "slice long, term string, places array<int>, times array<int>"
    )
    lists = postings.join(wanted, "term").select("owner", "bundle", "slice", "weight", "items", "places", "times")
    lists = materialize(lists, "postings", ["owner"])
    each = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    state = slices.select(
        each, "slice", "ids", "lengths",
        F.array().cast("array<int>").alias("items"), F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("scores"),
    )
    for turn in range(owners):
        last = turn == owners - 1
        own = lists.where(F.col("owner") == turn).select(
            F.col("bundle").alias("of"), F.col("slice").alias("at"), "weight", "items", "places", "times"
        )
        visit = _visitor(last, documents, terms, best)
        met = state.groupBy("bundle", "slice").cogroup(own.groupBy("of", "at"))
        state = met.applyInArrow(visit, "bundle int, item int, doc_id long, score long" if last else STATE)
    order = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(numbered, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")

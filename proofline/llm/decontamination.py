"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item (the whole item if it is shorter). Its
fingerprint is the smallest hash of the five-word grams in it. Equal windows have equal
fingerprints, so every shared span of ten words is met; and consecutive windows mostly share
theirs, so a text has few. Fingerprints of training texts that a filter of the benchmark's
fingerprints lets pass are extended to the windows around them, and these are joined to the
benchmark's by fingerprint and by their words. So a hash alone never decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import LOWER, NOT_WORD, mixed, sliding_min, text_slices, word_bounds, words64
from proofline.session import materialize

WINDOW_WORDS = 10
GRAM_WORDS = 5
#: Bits of the filter: sixteen a fingerprint, at least 8 KB and at most 16 MB in all.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
WINDOW_TYPE = pa.list_(
    pa.struct([("words", pa.int32()), ("print", pa.int64()), ("window", pa.string()), ("starts", pa.list_(pa.int64()))])
)
WINDOW_DDL = "array<struct<words: int, print: bigint, window: string, starts: array<bigint>>>"


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of a padded, lower-cased buffer, eight bytes at a time."""
    lanes = words64(low)
    rest = (ends - starts).astype(np.int64)
    at = starts.astype(np.int64)
    out = mixed(rest.astype(np.uint64))
    live = np.flatnonzero(rest > 0)
    while len(live):
        missing = 8 * (8 - np.minimum(rest[live], 8)).astype(np.uint64)
        lane = (lanes[at[live]] << missing) >> missing
        out[live] = mixed(out[live] ^ lane)
        at[live] += 8
        rest[live] -= 8
        live = live[rest[live] > 0]
    return out


def window_prints(hashes: np.ndarray, words: int, gram: int = GRAM_WORDS) -> np.ndarray:
    """The fingerprint of the window that starts at each word; texts are not told apart here."""
    gram = min(gram, words)
    count = len(hashes) - gram + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    grams = mixed(hashes[:count])
    for step in range(1, gram):
        grams = mixed(grams ^ hashes[step : step + count])
    return sliding_min(grams, words - gram + 1)


def _places(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a fingerprint in a filter of ``bits`` (a power of two) bits."""
    other = mixed(prints)
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (prints, other, other >> np.uint64(32))]


def _may_have(filter_bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bits = 8 * len(filter_bits)
    good = np.ones(len(prints), dtype=bool)
    for place in _places(prints, bits):
        good &= (filter_bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return good


def _windows(data: np.ndarray, offsets: np.ndarray, lengths: list[int], wanted) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each row, and its windows whose fingerprints are wanted, equal windows together."""
    low = LOWER[data]
    starts, ends, counts = word_bounds(low, offsets, NOT_WORD)
    hashes = word_hashes(low, starts, ends)
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    found: list[dict[tuple[int, str], dict]] = [{} for _ in counts]
    for words in lengths:
        prints = window_prints(hashes, words)
        if not len(prints):
            continue
        fits = (first + counts)[row[: len(prints)]] - np.arange(len(prints)) >= words
        # A fingerprint is looked up once for a run of windows that share it.
        change = np.append(True, prints[1:] != prints[:-1])
        runs = np.flatnonzero(change)
        good = np.repeat(wanted(prints[runs], words), np.diff(np.append(runs, len(prints))))
        for at in np.flatnonzero(good & fits):
            text = b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(at, at + words)).decode("utf-8")
            entry = found[row[at]].setdefault(
                (words, text), {"words": words, "print": int(prints[at].view(np.int64)), "window": text, "starts": []}
            )
            entry["starts"].append(int(at - first[row[at]]))
    return counts, [list(f.values()) for f in found]


def _document_windows(batches: Iterator[pa.RecordBatch], lengths: list[int], bits) -> Iterator[pa.RecordBatch]:
    filter_bits = np.frombuffer(bits.value, np.uint8)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, last, data, offsets in text_slices(batch.column("text")):
            counts, found = _windows(data, offsets, lengths, lambda prints, _: _may_have(filter_bits, prints))
            # Rows with equal id and text have equal results, so the key may be shared.
            keys = [
                hashlib.sha256(f"{ids[first + i]}|".encode() + data[offsets[i] : offsets[i + 1]].tobytes()).hexdigest() if f else None
                for i, f in enumerate(found)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first:last], pa.int64()), pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(found, WINDOW_TYPE)],
                ["doc_id", "key", "n_words", "windows"],
            )


def _item_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for first, last, data, offsets in text_slices(batch.column("text")):
            *_, counts = word_bounds(LOWER[data], offsets, NOT_WORD)
            needed = np.minimum(counts, size)
            lengths = sorted(int(x) for x in set(needed) if x)
            _, found = _windows(data, offsets, lengths, lambda prints, _: np.ones(len(prints), bool))
            rows = [(ids[first + i], w) for i, f in enumerate(found) for w in f if w["words"] == needed[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1]["words"] for r in rows], pa.int32()),
                    pa.array([r[1]["print"] for r in rows], pa.int64()),
                    pa.array([r[1]["window"] for r in rows], pa.string()),
                ],
                ["item_id", "words", "print", "window"],
            )


def _filter_bits(prints: DataFrame) -> bytes:
    """The filter as bytes: words of it are made by aggregation, so at most 16 MB reach the driver."""
    count = prints.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(count, 1) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.concatenate(_places(value, bits)) if len(value) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place >> 5), pa.array(np.int64(1) << (place & 31))], ["word", "bit"]
            )

    table = prints.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    whole = np.zeros(bits // 32, dtype="<u4")
    whole[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64).astype(np.uint32)
    return whole.tobytes()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, with_key: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    ``items`` has item_id and text. Null and wordless texts have no words and hit nothing; items
    without words have no windows, items without an id mark words but are not counted. Repeated
    rows get equal results, repeated items count once, and an empty benchmark leaves all clean.
    """
    spark = docs.sparkSession
    bench = materialize(
        items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(partial(_item_windows, size=size), "item_id string, words int, print long, window string")
        .distinct(),
        "benchmark",
    )
    lengths = sorted(r.words for r in bench.select("words").distinct().collect())  # at most ``size`` values
    bits = spark.sparkContext.broadcast(_filter_bits(bench.select("print").distinct()))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(
        narrow.mapInArrow(
            partial(_document_windows, lengths=lengths, bits=bits), f"doc_id long, key string, n_words long, windows {WINDOW_DDL}"
        ),
        "windows",
    )
    known = bench.select("words", "print", "window").distinct()
    hits = (
        scanned.where("key is not null")
        .select("key", F.explode("windows").alias("w"))
        .select("key", "w.*")
        .join(known, ["words", "print", "window"], "left_semi")
        .withColumn("name", F.sha2("window", 256))
    )
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("words") - 1)))
    marked = materialize(
        hits.groupBy("key").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).cast("long").alias("n_hit"),
            F.array_sort(F.collect_set("name")).alias("names"),
        ),
        "hits",
    )
    # Texts that hold the same windows, such as copies, meet the items once for all of them.
    sets = marked.select("names").distinct().withColumn("set", F.sha2(F.concat_ws(",", "names"), 256))
    by_window = bench.select(F.sha2("window", 256).alias("name"), "item_id").where("item_id is not null").distinct()
    listed = (
        sets.select("set", F.explode("names").alias("name"))
        .join(by_window, "name")
        .groupBy("set")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    )
    none = hashlib.sha256(b"").hexdigest()
    result = marked.select("key", "n_hit", F.sha2(F.concat_ws(",", "names"), 256).alias("set")).join(listed, "set", "left").drop("set")
    filled = [
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    met = scanned.where("key is not null").select("doc_id", "key", "n_words").join(result.dropDuplicates(["key"]), "key", "left")
    clean = scanned.where("key is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
        F.lit(none).alias("items_sha256"), F.lit(False).alias("contaminated"),
    )
    met = met.select("doc_id", "n_words", *filled, "key")
    return met.union(clean.withColumn("key", F.lit(None).cast("string"))) if with_key else met.drop("key").union(clean)


def without_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, all columns as they are."""
    hit = decontaminate(docs, items, size, with_key=True).where("contaminated").select(F.col("key").alias("_key")).distinct()
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("_key", F.sha2(name, 256)).join(hit, "_key", "left_anti").select(*docs.columns)

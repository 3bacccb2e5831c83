"""Which texts contain which phrases as whole words, without comparing every text with every phrase.

Phrases are numbered by their normalised words, each once. A set of at most ``AUTOMATON_CHARS``
characters becomes one automaton, built once in every task that reads texts: one walk over a text
finds all its phrases however their openings overlap, and nothing is shuffled. A larger set is never
sent to tasks whole: the runs of words of each text meet the phrases in an equality join on the whole
run, so an opening that many phrases share brings no candidates. A bounded filter of the phrases'
keys keeps most other runs from moving; it lets every phrase pass, and the join is exact. Both
ways give the same rows; the size of the set decides only which is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as X

AUTOMATON_CHARS = 2_000_000
#: Bytes of text whose runs are hashed at once, and texts that walk through an automaton at once.
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 256
#: Size of the filter in bits, and bytes of a part of it (fixed by ``bitmap_construct_agg``).
LEAST_BITS, MOST_BITS, PART_BYTES = 1 << 20, 1 << 27, 4096
#: An odd number and its inverse, and an odd number to mix with.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
MIXER = np.uint64(0xBF58476D1CE4E5B9)


def _words(normalized: Column) -> Column:
    return F.split(F.btrim(normalized), " ")


def said(words: Column, phrases: list[str]) -> Column:
    """Positions in ``phrases`` (normalised, padded) of those that occur in a ``normalize_words``
    text, each once, ascending. Null and empty texts say nothing."""

    @F.arrow_udf("array<int>")
    def walk(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, phrase in enumerate(phrases):
            automaton.add_word(phrase, number)
        automaton.make_automaton()
        for batch in texts:
            # Few texts of a batch are Python objects at once.
            found = []
            for first in range(0, len(batch), SLICE_TEXTS):
                some = batch.slice(first, SLICE_TEXTS).to_pylist()
                found.append(pa.array([sorted({n for _, n in automaton.iter(t)}) if t else [] for t in some], pa.list_(pa.int32())))
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return walk(words) if phrases else F.array().cast("array<int>")


def says_any(words: Column, phrases: list[str]) -> Column:
    """Whether a ``normalize_words`` text contains any of the phrases, given in normalised form."""
    return F.size(said(words, sorted(set(phrases)))) > 0


def _turned(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIXER
    return values ^ (values >> np.uint64(29))


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter of ``bits``, a power of two."""
    mask = np.uint64(bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a batch about ``SLICE_BYTES`` at a time: first row, bytes, and where each row begins.
    A null is empty."""
    raw = texts.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(raw):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        data = b"".join(x or b"" for x in raw.slice(first, last - first).to_pylist())
        yield first, np.frombuffer(data, np.uint8), np.append(0, ends[first:last] - before)
        first = last


def _runs(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first byte, end and key of every run of each length. A run has the space before it and the one
    behind it, like a normalised phrase; its key is a polynomial over its bytes, from sums over the slice."""
    factors = np.full(len(data) + 1, FACTOR, np.uint64)
    back = np.full(len(data) + 1, INVERSE, np.uint64)
    factors[0] = back[0] = 1
    np.multiply.accumulate(factors, out=factors)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * factors[:-1], out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    row = np.searchsorted(offsets, spaces, side="right") - 1
    for length in lengths:
        inside = np.flatnonzero(row[length:] == row[: max(len(row) - length, 0)])
        start, end = spaces[inside], spaces[inside + length] + 1
        yield row[inside], start, end, _turned((sums[end] - sums[start]) * back[start])


def _run_filter(numbered: DataFrame, lengths: list[int]) -> bytes:
    """A filter that the key of every phrase passes; at most ``MOST_BITS`` bits reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * numbered.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _slices(batch.column("_phrase")):
                for row, start, end, keys in _runs(data, offsets, lengths):
                    # Only the run that is the whole phrase.
                    whole = keys[(start == offsets[row]) & (end == offsets[row + 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(whole, bits)))], ["_place"])

    # The functions number buckets and bits from one.
    place = F.col("_place") + 1
    parts = (
        numbered.select("_phrase").mapInArrow(places, "_place long")
        .groupBy(F.bitmap_bucket_number(place).alias("_part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )
    whole = np.zeros(bits // 8, np.uint8)
    for part in parts.toLocalIterator():
        begin = (part["_part"] - 1) * PART_BYTES
        whole[begin : begin + PART_BYTES] = np.frombuffer(part["_bits"], np.uint8)[: len(whole) - begin]
    return whole.tobytes()


def _hits_by_runs(texts: DataFrame, numbered: DataFrame, text_id: str) -> DataFrame:
    """(text_id, _phrase) by an equality join on whole runs, for sets of any size. Only runs that a
    filter of the phrases' keys lets pass leave the task of their text."""
    # Lengths in words: distinct lengths number at most the root of twice the words of the set.
    lengths = sorted(row["_n"] for row in numbered.select(F.size(_words(F.col("_phrase"))).alias("_n")).distinct().collect())
    if not lengths:
        return texts.select(text_id, F.lit("").alias("_phrase")).where(F.lit(False))
    bits = texts.sparkSession.sparkContext.broadcast(_run_filter(numbered, lengths))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for first, data, offsets in _slices(batch.column("words")):
                rows, said_there = [], []
                for row, start, end, keys in _runs(data, offsets, lengths):
                    one, two = _places(keys, 8 * len(held))
                    for at in np.flatnonzero((held[one >> 3] >> (one & 7)) & (held[two >> 3] >> (two & 7)) & 1):
                        rows.append(first + int(row[at]))
                        said_there.append(data[start[at] : end[at]].tobytes())
                ids = batch.column(text_id).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(said_there, pa.binary()).cast(pa.string())], [text_id, "_phrase"])

    kind = texts.schema[text_id].dataType.simpleString()
    runs = texts.select(text_id, "words").mapInArrow(passing, f"`{text_id}` {kind}, _phrase string")
    return runs.join(numbered, "_phrase").select(text_id, "_phrase").distinct()


def phrase_hits(
    texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str, most_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """(text_id, phrase_id), once per pair. ``texts``: text_id, words (``normalize_words``).
    ``phrases``: phrase_id, phrase. A phrase without words, or null, is never found."""
    named = phrases.select(phrase_id, X.normalize_words(F.col("phrase")).alias("_phrase")).where(
        F.btrim("_phrase") != ""
    )
    numbered = named.select("_phrase").distinct()
    size = numbered.agg(F.coalesce(F.sum(F.length("_phrase")), F.lit(0))).first()[0]
    if size > most_chars:
        hits = _hits_by_runs(texts, numbered, text_id)
    else:
        # At most ``most_chars`` characters.
        known = sorted(row["_phrase"] for row in numbered.collect())
        found = texts.select(text_id, F.explode(said(F.col("words"), known)).alias("_number"))
        listed = texts.sparkSession.createDataFrame(list(enumerate(known)), "_number int, _phrase string")
        hits = found.join(listed, "_number").select(text_id, "_phrase")
    return hits.join(named, "_phrase").select(text_id, phrase_id).distinct()


def without_phrases(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str) -> DataFrame:
    """Texts that contain none of the phrases."""
    hits = phrase_hits(texts, phrases, text_id, phrase_id)
    return texts.join(hits.select(text_id).distinct(), text_id, "left_anti")

"""Spelling variants through an index of variable-length grams.

A gram dictionary holds every pair of letters and, where the opening of a gram is frequent, the
longer gram too, up to a fixed number of grams. A word is cut into the longest grams that start at
its letters, without those that lie inside the one before. For every place of an edit the grams it
may touch are counted; the largest count bounds what two words one edit apart may lose, so they
must share one of the rarest grams (that count plus one) of each. Only these lists are merged.

Two words are compared under the length of the longer one, and a gram is at most half as long as
that. So at least one gram lies clear of any single edit, whatever the dictionary holds, and no word
is without a bound. A shared gram starts at the same letter in both words, or one letter earlier in
the shorter one, so lists are kept by gram, place and length. The pairs of a list are verified letter
by letter. A list beyond ``MOST_LIST`` words is cut further by the words' forms without one letter (or
the halves of words beyond ``MOST_CUT`` letters).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import LOWER, ranges, text_slices
from proofline.session import materialize

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A run of a text whose hash this number divides loses one letter.
THINNING = 199
#: A form is at least so many times as frequent as its variant.
FORM_RATIO = 5
#: A gram is extended if more words than this hold it, and at most so many long grams are kept.
#: Both decide how long lists are, never a result; the dictionary is all that is broadcast.
LONG_GRAM, MOST_GRAMS, MOST_LETTERS = 64, 1 << 17, 6
#: Words of a list that are compared pair by pair.
MOST_LIST = 128
#: Letters of words compared as rows of one array; longer ones are compared one by one.
ROW = 32
#: Letters of words in long lists that are compared through their forms without one letter.
MOST_CUT = 64
SLICE = 1 << 22

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
#: First byte of U+00C0 to U+00FF in UTF-8; every byte after it belongs to one of them.
LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def run_crcs(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, continued from the crc32 of what stands before it."""
    state = opening.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live, step = np.flatnonzero(sizes > 0), 0
    while len(live) and step < 64:
        state[live] = CRC[(state[live] ^ low[starts[live] + step]) & np.uint32(0xFF)] ^ (state[live] >> np.uint32(8))
        step += 1
        live = live[sizes[live] > step]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in live:
        out[i] = zlib.crc32(low[starts[i] + step : starts[i] + sizes[i]].tobytes(), int(out[i]))
    return out


def slice_words(data: np.ndarray, offsets: np.ndarray, ids: list[int | None]) -> pa.Array:
    """The words of a slice of texts, one entry for each occurrence."""
    size = int(offsets[-1])
    low = LOWER[data]
    lead = data[:size] == LEAD
    inside = LETTER[data[:size]] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[:size] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True)[:size] | edge[1:])) + 1
    pairs = np.append(0, np.cumsum(lead))
    letters = ends - starts - (pairs[ends] - pairs[starts])
    long = letters >= LEAST_LETTERS
    starts, ends, letters = starts[long], ends[long], letters[long]
    row = np.searchsorted(offsets[1:], starts, side="right")
    named = np.array([x is not None for x in ids], dtype=bool)
    opening = np.array([0 if x is None else zlib.crc32(f"{x}:".encode()) for x in ids], dtype=np.uint32)
    hashes = run_crcs(low, starts, ends - starts, opening[row])
    cut = (hashes % THINNING == 0) & named[row]
    whole = np.flatnonzero(~cut)
    sizes = ends[whole] - starts[whole]
    places = np.append(0, np.cumsum(sizes)).astype(np.int32)
    kept = pa.StringArray.from_buffers(
        len(whole), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(low[ranges(starts[whole], sizes)]))
    )
    thinned = []
    for i in np.flatnonzero(cut & (letters > LEAST_LETTERS)):
        run = low[starts[i] : ends[i]].tobytes().decode("utf-8")
        gone = int(hashes[i]) % len(run)
        thinned.append(run[:gone] + run[gone + 1 :])
    return pa.concat_arrays([kept, pa.array(thinned, pa.string())])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, last, data, offsets in text_slices(batch.column("text"), SLICE):
            counted = pc.value_counts(slice_words(data, offsets, ids[first:last]))
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])


def counted_words(docs: DataFrame) -> DataFrame:
    """id, word, n: the words of at least six letters met at least five times. Ids follow the words'
    code-point order."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = narrow.mapInArrow(_word_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counts.where(F.col("n") >= LEAST_COUNT), "words")
    return materialize(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "numbered-words")


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams that words of their length may be cut into, with their numbers in a batch."""
    for batch in batches:
        found: Counter[str] = Counter()
        for word in batch.column("word").to_pylist():
            size = len(word)
            for q in range(2, min(MOST_LETTERS, (size + 1) // 2) + 1):
                found.update(word[at : at + q] for at in range(size - q + 1))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"])


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """The gram dictionary: each gram and its rank, the rarest first. A gram of three letters or
    more is in it if the one without its last letter is frequent; beyond ``MOST_GRAMS`` the rarer
    ones are left out. Pairs of letters are bounded by the alphabet."""
    counted = words.select("word").mapInArrow(_gram_batches, "gram string, n long")
    grams = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "grams")
    frequent = grams.where(F.col("n") > LONG_GRAM).select(F.col("gram").alias("opening"))
    opening = F.expr("left(gram, length(gram) - 1)")
    longer = grams.where(F.length("gram") > 2).withColumn("opening", opening).join(frequent, "opening", "left_semi")
    kept = longer.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS).select("gram", "n")
    found = kept.union(grams.where(F.length("gram") == 2).select("gram", "n")).toArrow().to_pylist()
    found.sort(key=lambda g: (g["n"], g["gram"]))
    return {g["gram"]: rank for rank, g in enumerate(found)}


def openings(ranks: dict[str, int]) -> dict[str, int]:
    """The proper openings of the dictionary's grams, with the length of the shortest gram each opens."""
    found: dict[str, int] = {}
    for gram in ranks:
        for size in range(1, len(gram)):
            found[gram[:size]] = min(found.get(gram[:size], len(gram)), len(gram))
    return found


def cut_word(word: str, most: int, ranks: dict[str, int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of the grams of a word, and where the longest gram at each letter ends."""
    size, reach, grams, ends = len(word), 0, [], []
    for start in range(size - 1):
        end = next((start + q for q in range(min(most, size - start), 2, -1) if word[start : start + q] in ranks), start + 2)
        ends.append(end)
        if end > reach:
            grams.append((start, end))
            reach = end
    return grams, ends


def most_touched(word: str, most: int, grams: list[tuple[int, int]], ends: list[int], opens: dict[str, int]) -> int:
    """How many grams of a word one edit can touch at most.

    An edit at a letter (changed, removed, or another put before it) can change the longest gram at
    any letter from which a gram reaches it, or could with other letters behind. From the first
    such letter on, grams up to the edit count as touched, and so do those behind it that a gram
    ending up to ``most`` letters after it could cover.
    """
    size, worst = len(word), 0
    starts, stops = [start for start, _ in grams], [end for _, end in grams]
    for at in range(size + 1):
        first = next(
            (
                start
                for start in range(max(0, at - most + 1), at)
                if (start < len(ends) and ends[start] > at) or opens.get(word[start:at], most + 1) <= most
            ),
            at,
        )
        # Starts and ends both rise along the grams.
        worst = max(worst, max(bisect_right(starts, at), bisect_right(stops, at + most)) - bisect_left(starts, first))
    return worst


def _keys(word: str, length: int, ranks: dict[str, int], opens: dict[str, int]) -> list[int]:
    """The lists of a word among pairs whose longer word has ``length`` letters."""
    most = min(MOST_LETTERS, length // 2)
    grams, ends = cut_word(word, most, ranks)
    needed = min(len(grams), most_touched(word, most, grams, ends, opens) + 1)
    ranked = sorted((ranks.get(word[start:end], -1), start) for start, end in grams)[:needed]
    shifts = (0, 1) if len(word) < length else (0,)
    return [((rank + 1) << 40) | ((start + shift & 0xFFFFF) << 20) | (length & 0xFFFFF) for rank, start in ranked for shift in shifts]


def _entry_batches(batches: Iterator[pa.RecordBatch], dictionary) -> Iterator[pa.RecordBatch]:
    ranks, opens = dictionary.value
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = [sorted({*_keys(w, len(w), ranks, opens), *_keys(w, len(w) + 1, ranks, opens)}) for w in words]
        sizes = np.array([len(k) for k in keys], dtype=np.int64)
        row = pa.array(np.repeat(np.arange(len(words)), sizes))
        flat = pa.array([k for ks in keys for k in ks], pa.int64())
        yield pa.RecordBatch.from_arrays([flat, *(batch.column(n).take(row) for n in ("id", "word", "n"))], ["key", "id", "word", "n"])


def near(first: str, second: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    longer, shorter = (first, second) if len(first) >= len(second) else (second, first)
    if len(longer) - len(shorter) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(longer, shorter)) if x != y), len(shorter))
    return at < len(longer) and longer[at + 1 :] == shorter[at + (len(longer) == len(shorter)) :]


def _near_rows(rows: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``near`` for pairs of rows of letters, padded with zeros; the left word is not the shorter."""
    longer, shorter = rows[left], rows[right]
    differs = longer != shorter
    same = sizes[left] == sizes[right]
    out = same & (differs.sum(axis=1) == 1)
    other = np.flatnonzero(sizes[left] == sizes[right] + 1)
    if len(other):
        first = differs[other].argmax(axis=1)
        behind = (longer[other, 1:] != shorter[other, :-1]) & (np.arange(rows.shape[1] - 1) >= first[:, None])
        out[other] = ~behind.any(axis=1)
    return out


def _list_pairs(keys: np.ndarray, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of whole lists; the words of a list come by falling length."""
    count = len(keys)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    run = np.diff(np.append(begin, count))
    left_in_list = np.repeat(begin + run, run) - np.arange(count)
    short = sizes <= ROW
    rows = np.zeros((count, ROW), dtype=np.uint8)
    texts = words.to_pylist()
    for i in np.flatnonzero(short):
        rows[i, : sizes[i]] = np.frombuffer(texts[i].encode("latin-1"), dtype=np.uint8)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, step = np.flatnonzero(left_in_list > 1), 1
    while len(live):
        other = live + step
        matrix = short[live] & (sizes[live] - sizes[other] <= 1)
        for part in np.array_split(live[matrix], 1 + int(matrix.sum()) // (1 << 16)):
            good = _near_rows(rows, sizes, part, part + step)
            left.append(part[good])
            right.append(part[good] + step)
        wide = [i for i in live[~short[live]] if near(texts[i], texts[i + step])]
        left.append(np.array(wide, dtype=np.int64))
        right.append(np.array(wide, dtype=np.int64) + step)
        step += 1
        live = live[left_in_list[live] > step]
    return np.concatenate(left), np.concatenate(right)


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted entries as tables of whole lists; a list goes on into the next batch."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        whole = whole if kept is None else pa.concat_tables([kept, whole]).combine_chunks()
        keys = whole.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        kept = whole.slice(last)
        if last:
            yield whole.slice(0, last)
    if kept is not None:
        yield kept


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs: id, other, n of the other word."""
    for table in _whole_lists(batches):
        key, word, n, size = (table.column(c).to_numpy() for c in ("key", "id", "n", "size"))
        left, right = _list_pairs(key, table.column("word").combine_chunks(), size.astype(np.int64))
        one, two = np.append(left, right), np.append(right, left)
        links, at = np.unique(np.stack([word[one], word[two]], axis=1), axis=0, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.array(n[two][at])], ["id", "other", "n"])


def _rests() -> Column:
    """What two words one edit apart have in common: the word, or what is left of the longer one
    without a letter. Words too long for that share their first or their last half, cut for the
    longer one's length."""
    letters = F.length("word")
    without = F.transform(
        F.sequence(F.lit(1), letters), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1, letters))
    )
    halves = [
        F.concat(F.lit(side), length.cast("string"), F.call_function(side, F.col("word"), F.floor((length - 1) / 2).cast("int")))
        for length in (letters, letters + 1)
        for side in ("left", "right")
    ]
    none = F.array().cast("array<string>")
    short = F.when(letters <= MOST_CUT, F.array_distinct(F.array_append(without, F.col("word")))).otherwise(none)
    return F.concat(short, F.when(letters >= MOST_CUT, F.array(*halves)).otherwise(none))


def near_pairs(words: DataFrame) -> DataFrame:
    """id, other, n: every ordered pair of near words of ``words`` (id, word, n), with the n of the other."""
    spark = words.sparkSession
    ranks = gram_ranks(words)
    dictionary = spark.sparkContext.broadcast((ranks, openings(ranks)))
    listed = words.select("id", "word", "n").mapInArrow(
        partial(_entry_batches, dictionary=dictionary), "key long, id long, word string, n long"
    )
    listed = materialize(listed, "gram-lists")
    sized = listed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    entries = listed.join(sized, "key")
    within = entries.where(F.col("members") <= MOST_LIST).select(*listed.columns)
    beyond = entries.where(F.col("members") > MOST_LIST).select("id", "word", "n").distinct()
    cut = beyond.select(F.explode(_rests()).alias("rest"), "id", "word", "n").select(F.xxhash64("rest").alias("key"), "id", "word", "n")

    def pairs(lists: DataFrame) -> DataFrame:
        rows = lists.withColumn("size", F.length("word"))
        dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("size"), "id")
        return dealt.mapInArrow(_pair_batches, "id long, other long, n long")

    return pairs(within).union(pairs(cut))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs`` (doc_id, text).

    A null text has no words, a text without an id loses no letters, and each row of a repeated
    document counts. Words are at least six letters and met five times. Ties of forms go to
    the smallest word; an empty table gives no rows.
    """
    words = counted_words(docs)
    links = near_pairs(words).repartition("id").groupBy("id", "other").agg(F.max("n").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("other")).alias("less"))).alias("best")
    met = materialize(links.groupBy("id").agg(F.count("*").alias("n_near"), best), "near-words")
    named = words.join(met, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= FORM_RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    named = materialize(named.select("id", "word", "n", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.less")).alias("form")), "forms")
    # n grows fivefold along a chain, so the jumps are few.
    chain = materialize(named.where("form is not null").select("id", F.col("form").alias("root")), "chain")
    while True:
        above = chain.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        chain = materialize(
            chain.join(above, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jumps"
        )
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    text = words.select("id", "word")
    form = text.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    root = chain.select("id", "root").join(text.withColumnRenamed("id", "root"), "root").select("id", F.col("word").alias("root_word"))
    return named.join(form, "form", "left").join(root, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )

"""SimHash near-duplicates through an index of byte positions.

Fingerprints that differ in at most two bits share at least six of their eight bytes. Counting the
shared bytes of pairs from one-byte lists would meet every pair with a common byte, a share of
1/256 of all pairs. The index therefore lists a fingerprint under each set of six positions, the
guaranteed number of matches: a pair that any list brings together has reached the count, and a
pair that reaches it is in a list. A list holds at most 65,536 distinct fingerprints, since only two
bytes are free. Inside a list the remaining two bytes are tallied and the bits verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import LOWER, SPACE, PAD, ranges, text_slices, word_bounds, words32, words64
from proofline.llm.components import components
from proofline.llm.decontamination import _filter_bits, _may_have
from proofline.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Bytes and offsets of a slice to one number a row.
Prints = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Primes of the XXH64 hash (fixed values).
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
#: Longest list compared pair by pair; beyond it a table of the two free bytes is used.
SMALL_LIST = 32


def _turn(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of one padded buffer at once."""
    eight, four = words64(data), words32(data)
    at = starts.astype(np.int64)
    size = lengths.astype(np.uint64)
    out = np.full(len(at), np.uint64(seed) + P5, dtype=np.uint64)
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        start = np.uint64(seed)
        with np.errstate(over="ignore"):
            first = np.array([start + P1 + P2, start + P2, start, start - P1], dtype=np.uint64)
        lanes = np.repeat(first[:, None], len(long), axis=1)
        place, blocks = at[long], lengths[long] // 32
        for turn in range(int(blocks.max())):
            live = np.flatnonzero(blocks > turn)
            for lane in range(4):
                read = eight[place[live] + 32 * turn + 8 * lane]
                lanes[lane, live] = _turn(lanes[lane, live] + read * P2, 31) * P1
        joined = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in range(4):
            joined = (joined ^ (_turn(lanes[lane] * P2, 31) * P1)) * P1 + P4
        out[long] = joined
        at = at.copy()
        at[long] += 32 * blocks
    out += size
    rest = (lengths % 32).astype(np.int64)
    for _ in range(3):
        live = np.flatnonzero(rest >= 8)
        if not len(live):
            break
        out[live] = _turn(out[live] ^ (_turn(eight[at[live]] * P2, 31) * P1), 27) * P1 + P4
        at[live] += 8
        rest[live] -= 8
    live = np.flatnonzero(rest >= 4)
    out[live] = _turn(out[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
    at[live] += 4
    rest[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(rest >= 1)
        if not len(live):
            break
        out[live] = _turn(out[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        rest[live] -= 1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of ``words`` words of a slice, row after row, and how many each row has.
    A shorter text is one run."""
    starts, ends, counts = word_bounds(data, offsets, SPACE)
    lengths = ends - starts
    plain = np.full(int(lengths.sum()) + len(lengths) + PAD, 32, dtype=np.uint8)
    placed = np.cumsum(lengths + 1) - (lengths + 1)
    plain[ranges(placed, lengths)] = LOWER[data[ranges(starts, lengths)]]

    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first_word = np.cumsum(counts) - counts
    opening = ranges(first_word, shingles)
    closing = np.minimum(opening + words - 1, np.repeat(first_word + counts - 1, shingles))
    begin = placed[opening]
    return xxh64(plain, begin, placed[closing] + lengths[closing] - begin), shingles


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of each row of a slice."""
    hashes, shingles = shingle_hashes(data, offsets, words)
    out = np.zeros(len(shingles), dtype=np.uint64)
    full = np.flatnonzero(shingles)
    if not len(full):
        return out
    # Each of the eight bytes of a word counts one bit; runs of 255 cannot overflow a byte.
    pieces = -(-shingles[full] // 255)
    begin = (np.cumsum(shingles) - shingles)[full]
    inner = ranges(np.zeros(len(pieces), dtype=np.int64), pieces)
    cuts = np.repeat(begin, pieces) + 255 * inner
    piece_at = np.cumsum(pieces) - pieces
    half = shingles[full][:, None]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), cuts)
        each = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        tall = np.add.reduceat(each, piece_at, axis=0)
        set_bits = (2 * tall > half).astype(np.uint8)
        out[full] |= np.ascontiguousarray(set_bits).view("<u8").ravel() << np.uint64(bit)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprints(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
        value = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value.view(np.int64))], ["doc_id", "fp"])


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fp: one row per row of ``docs``. A null text has no words and fingerprint zero."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _position_sets() -> Column:
    """One (set number, the fingerprint with two bytes blanked) for each set of six positions."""
    entries = []
    for number, free in enumerate(combinations(range(8), 2)):
        mask = (1 << 64) - 1
        for position in free:
            mask &= ~(0xFF << (8 * position))
        signed = mask - (1 << 64) if mask >> 63 else mask
        entries.append(F.struct(F.lit(number).cast("byte").alias("kind"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return F.explode(F.array(*entries))


BIT_PAIRS = np.array([(1 << i) | (1 << j) for i in range(16) for j in range(i, 16)], dtype=np.int64)


def _wide_list(values: np.ndarray, free: tuple[int, int], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long list, found by flipping one or two of the sixteen free bits."""
    low, high = ((values >> np.uint64(8 * p)) & np.uint64(0xFF) for p in free)
    short = (low | (high << np.uint64(8))).astype(np.int64)
    where = np.full(1 << 16, -1, dtype=np.int64)
    where[short] = np.arange(len(values))
    left, right = [], []
    for flip in BIT_PAIRS:
        other = where[short ^ flip]
        live = np.flatnonzero((other >= 0) & (short < (short ^ flip)))
        left.append(live + base)
        right.append(other[live] + base)
    return np.concatenate(left), np.concatenate(right)


def _list_links(kinds: np.ndarray, keys: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one sorted block whose fingerprints share six bytes and differ in few bits."""
    size = len(values)
    change = np.ones(size, dtype=bool)
    change[1:] = (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])
    begin = np.flatnonzero(change)
    run = np.diff(np.append(begin, size))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(np.where(run <= SMALL_LIST, run, 0), run)
    inside = np.arange(size) - np.repeat(begin, run)
    live = np.flatnonzero(small >= 2)
    step = 1
    while len(live):
        live = live[inside[live] + step < small[live]]
        other = live + step
        differs = values[live] ^ values[other]
        lanes = differs.view(np.uint8).reshape(-1, 8)
        shared = (lanes == 0).sum(axis=1)
        near = (shared >= 8 - max_bits) & (np.bitwise_count(differs) <= max_bits)
        left.append(live[near])
        right.append(other[near])
        step += 1
    pairs = list(combinations(range(8), 2))
    for at in np.flatnonzero(run > SMALL_LIST):
        a, b = _wide_list(values[begin[at] : begin[at] + run[at]], pairs[kinds[begin[at]]], int(begin[at]))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _star(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row linked to each row, directly or through others of the block."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted index entries to links; the last list of a batch waits for the next batch."""
    kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def links(block: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        left, right = _list_links(*block, MAX_BITS)
        label = _star(len(block[2]), left, right)
        moved = np.flatnonzero(label != np.arange(len(label)))
        values = block[2].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[label[moved]])], ["a", "b"])

    for batch in batches:
        read = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "key", "fp")]
        read[2] = read[2].view(np.uint64)
        whole = tuple(np.concatenate([k, r]) for k, r in zip(kept, read, strict=True))
        last = np.flatnonzero((whole[1] != whole[1][-1]) | (whole[0] != whole[0][-1])) if len(whole[0]) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        kept = tuple(x[cut:] for x in whole)
        if cut:
            yield links(tuple(x[:cut] for x in whole))
    if len(kept[0]):
        yield links(kept)


def near_links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at most two bits apart. Inside a list
    every member is linked to the first one it reaches, so the links keep each component whole
    without listing the pairs of a group."""
    index = prints.select("fp", _position_sets().alias("entry")).select("entry.kind", "entry.key", "fp")
    dealt = index.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, group, component_id: one row per row of ``docs``.

    group is the smallest fingerprint (as a signed number) of the component; component_id is the
    smallest doc_id in it, null if no member has an id. Empty texts share fingerprint zero and are
    linked like any other; repeated rows fall into one component; an empty table gives no rows.
    """
    prints = materialize(simhash(docs), "simhash")
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = components(near_links(each.select("fp")))
    rooted = each.join(found, each.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    rooted = materialize(rooted, "groups")
    least = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    placed = rooted.select("fp", "group").join(least, "group")
    return prints.join(placed, "fp").select("doc_id", "fp", "group", "component_id")


def fingerprint_hex(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def id_filter(ids: DataFrame) -> bytes:
    """A filter of at most 16 MB that every id of ``ids`` (column id) passes."""
    return _filter_bits(ids.where("id is not null").select(F.xxhash64("id").alias("print")))


def may_hold(bits: bytes, ids: pa.Array) -> np.ndarray:
    """Whether each id passes the filter; a row without an id does."""
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    raw = np.concatenate([known.view(np.uint8), np.zeros(PAD, np.uint8)])
    prints = xxh64(raw, 8 * np.arange(len(known)), np.full(len(known), 8)) if len(known) else np.zeros(0, np.uint64)
    return _may_have(np.frombuffer(bits, np.uint8), prints) | pc.is_null(ids).to_numpy(zero_copy_only=False)


def _settled_batches(bits, prints: Prints | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows outside a filter of ids; with ``prints`` those inside, and their fp."""
    for batch in batches:
        inside = may_hold(bits.value, batch.column("doc_id").cast(pa.int64()))
        rows = batch.filter(pa.array(inside if prints else ~inside))
        if not prints:
            yield rows
            continue
        texts = rows.column("text").cast(pa.string())
        found = [prints(data, offsets) for _, _, data, offsets in text_slices(texts)]
        value = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(value.view(np.int64))], [*rows.schema.names, "_fp"])


def one_of_each(
    docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates, prints: Prints = fingerprints
) -> DataFrame:
    """The row of each component with the smallest doc_id, all columns as they are. Of repeated
    rows one stays; a row without an id stays only if no member of its component has one. ``find``
    gives the components like ``near_duplicates``, ``prints`` the fp of the rows of a slice.

    Most rows are the only ones of their id and stay; they are not moved. The others are settled by
    a join. A bounded filter of their ids parts the two, so rows it lets pass in vain are settled too.
    """
    found = materialize(find(docs).select("doc_id", "fp", "group", "component_id"), "found")
    # An id may stand on several texts, so the chosen row of a group is named by id and fp.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(first.groupBy("group").agg(F.min("doc_id").alias("_id"), F.min("fp").alias("_fp")), "kept")
    placed = found.join(kept, "group").withColumn("_stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    alone = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("_stays")).alias("stay")).where("n > 1 OR stay = 0")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(alone.select(F.col("doc_id").alias("id"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    clear = docs.mapInArrow(partial(_settled_batches, bits, None), schema)
    named = docs.mapInArrow(partial(_settled_batches, bits, prints), f"{schema}, _fp long").withColumn("_id", F.col("doc_id").cast("long"))
    chosen = kept.select(F.col("_id").alias("_kept_id"), F.col("_fp").alias("_kept_fp"), F.col("group").alias("_group"))
    match = named._fp.eqNullSafe(chosen._kept_fp) & named._id.eqNullSafe(chosen._kept_id)
    rows = named.join(chosen, match).select(*[named[c] for c in docs.columns], "_group")
    return clear.union(rows.dropDuplicates(["_group"]).select(*docs.columns))

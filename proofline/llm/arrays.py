"""Texts of one Arrow batch as byte arrays, so that a task works on numpy columns instead of on
single strings. Everything here is local to one slice of a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Readable bytes behind every buffer, so that eight bytes can be loaded at any position.
PAD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False

#: Odd multipliers and shifts of a 64-bit finaliser (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values; distinct values keep distinct hashes."""
    out = values + STEP
    out ^= out >> np.uint64(30)
    out *= MIX_A
    out ^= out >> np.uint64(27)
    out *= MIX_B
    out ^= out >> np.uint64(31)
    return out


def words64(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte of a padded buffer."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def words32(data: np.ndarray) -> np.ndarray:
    return np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows; a null is an empty text.

    ``bytes[offsets[i]:offsets[i + 1]]`` is row ``first + i``; ``PAD`` zero bytes follow.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        cut = np.zeros(offsets[last] - offsets[first] + PAD, dtype=np.uint8)
        cut[:-PAD] = whole[offsets[first] : offsets[last]]
        yield first, last, cut, offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and how many words each row has."""
    size = int(offsets[-1])
    inside = ~separator[data[:size]]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(size, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(size, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets[1:], starts, side="right")
    return starts, ends, np.bincount(rows, minlength=len(offsets) - 1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out

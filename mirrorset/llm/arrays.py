"""Array views of text columns inside Arrow tasks: bytes, words, hashes, per-document sums.

A text column arrives as one byte array and document offsets. Words are maximal runs of bytes
other than space and 0x09-0x0D, which is the same as runs of code points in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that one step of an array job looks at; a longer document is a step of its own.
BLOCK = 1 << 21
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
_WORD_BYTE = np.where(SPACE, np.uint64(0), _BYTE)
_FOLDED_WORD_BYTE = _WORD_BYTE[FOLD]
_place = np.empty(0, np.uint64)


def place(n: int) -> np.ndarray:
    """Odd multipliers of the first n places of a word."""
    global _place
    if len(_place) < n:
        size = 1 << max(12, int(n).bit_length())
        _place = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return _place


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_blocks(column, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive documents of a text column."""
    data, offsets = utf8(column)
    for first, last in blocks(offsets, limit):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise array over every document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    solid = ~SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], stop[last] = solid[first], solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; spans are sorted, disjoint and not empty.

    ``table`` gives the value of each byte, zero for bytes that lie between spans.
    """
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            j = min(max(int(np.searchsorted(ends, starts[i] + _PIECE, "right")), i + 1), n)
            a, b = int(starts[i]), int(ends[j - 1])
            value = table[data[a:b]]
            at = starts[i:j] - a
            width = np.diff(np.append(at, b - a))
            within = np.arange(b - a) - np.repeat(at, width)
            value *= place(int(width.max()))[within]
            out[i:j] = np.add.reduceat(value, at)
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * _GOLD)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """(hash, start, end, document) of every word; ``fold`` lower-cases A-Z first."""
    starts, ends, doc = word_spans(data, offsets)
    return span_hashes(data, starts, ends, _FOLDED_WORD_BYTE if fold else _WORD_BYTE), starts, ends, doc


def line_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash, has a word, document) of every line that is not empty; lines end at a line feed."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
    feed = data == 10
    begin = np.zeros(len(data), bool)
    begin[1:] = feed[:-1]
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], len(data))
    ends = stops - feed[stops - 1]
    real = ends > starts
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
    table = _BYTE.copy()
    table[10] = 0
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    return (span_hashes(data, starts, ends, table), solid[ends] > solid[starts],
            np.searchsorted(offsets, starts, "right") - 1)

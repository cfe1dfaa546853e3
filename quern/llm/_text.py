"""Vectorised views of text columns: UTF-8 buffers, words and word hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Text bytes handled at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
IN_WORD = ~SPACE
FEED = np.zeros(256, bool)
FEED[10] = True

#: Bytes with A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32

#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
#: What is left of a span, at most 8 bytes, picks the bytes of a lane that count.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), places


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes."""
    data, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans.

    Spans are taken in lanes of 8 bytes, each of which is mixed in by a bijection, so different spans of one lane
    never share a hash; long spans are hashed by XXH3.
    """
    sizes = ends - starts
    found = mix(sizes.astype(np.uint64))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    rest = np.flatnonzero(sizes <= LONG_SPAN) if len(sizes) and sizes.max() > LONG_SPAN else np.arange(len(sizes))
    at = 0
    while len(rest := rest[sizes[rest] > at]):
        left = np.minimum(sizes[rest] - at, 8)
        found[rest] = mix(found[rest] ^ (lanes[starts[rest] + at] & _LANE[left]))
        at += 8
    for i in np.flatnonzero(sizes > LONG_SPAN):
        found[i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
    return found


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each row (n + 1 entries)."""
    edges = np.empty(len(data) + 1, bool)  # whether a place is in a word and the one before is not, or the other way round
    inside = IN_WORD[data]
    if not len(data):
        return (none := np.zeros(0, np.int64)), none, np.zeros(len(offsets), np.int64)
    edges[0], edges[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edges[1:-1])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    joined = inner[inside[inner - 1] & inside[inner]]  # rows that meet without white space
    places = np.flatnonzero(edges)
    if len(joined):
        places = np.sort(np.concatenate([places, np.repeat(np.unique(joined), 2)]))
    starts, ends = places[::2], places[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(data: np.ndarray, limit: int = SLICE_BYTES, cut: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of about ``limit`` bytes of one text, each but the first beginning with one of the bytes ``cut``; what has none of them is not cut."""
    first = 0
    while first < len(data):
        end = first + limit
        while end < len(data):
            spots = np.flatnonzero(cut[data[end : end + limit]])
            if len(spots):
                end += int(spots[0])
                break
            end += limit
        end = min(end, len(data))
        yield first, end
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of the first word of each row (n + 1 entries); ``letters``: what each byte counts as. One long text is taken in pieces."""
    if len(offsets) != 2:
        starts, ends, first = words(data, offsets)
        return span_hashes(data if letters is None else letters[data], starts, ends), first
    found = [np.zeros(0, np.uint64)]
    for a, b in pieces(data):
        starts, ends, _ = words(data[a:b], np.array([0, b - a]))
        found.append(span_hashes(data[a:b] if letters is None else letters[data[a:b]], starts, ends))
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


#: Odd, so that a step of ``chained`` loses nothing.
STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit hash of each row of ``parts``, in their order."""
    total = np.full(len(parts[0]), seed, np.uint64)
    for x in parts:
        total += x
        total *= STEP
        total ^= total >> np.uint64(29)
    return mix(total)

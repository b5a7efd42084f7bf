"""Arrow batches of texts as flat byte arrays, and words in them."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of every contract: space and the control characters 9 to 13.
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[IS_WHITE] = 0
_BYTE_LOW = _BYTE[LOWER]
#: Hash of the token that ends a text.
END = np.uint64(0xD1B54A32D192ED03)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    n = len(column)
    null = np.asarray(column.is_null()) if n else np.zeros(0, bool)
    if null.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0], null


def give_back() -> None:
    """Return freed memory to the system: a worker that has done with a large block keeps its executor's share small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(table: pa.RecordBatch | pa.Table, text: str, most: int):
    """Row ranges of at most ``most`` bytes of text, or of one row."""
    column = table.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = 0
    while start < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
        yield table.slice(start, n)
        start += n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of words of each text).

    A word is a run of bytes that are not white space; it never goes on in the next text.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~IS_WHITE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at_start = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at_start] |= inside[at_start]
    starts = np.flatnonzero(first)
    ends = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(ends)
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts[1:], n)
    i = 0
    while i < len(starts):  # a megabyte, or one word, at a time: arrays of words are eight times as large as the text
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + most, "right")))
        lo, hi = int(starts[i]), int(stops[j - 1])
        own = starts[i:j] - lo
        place = np.arange(hi - lo, dtype=np.int64)
        place -= np.repeat(own, np.diff(np.append(own, hi - lo)))
        power = np.ones(int(place.max()) + 1, np.uint64)
        power[1:] = _MULT
        value = np.multiply.accumulate(power)[place]
        value *= _BYTE_LOW[buf[lo:hi]]
        out[i:j] = mix64(np.add.reduceat(value, own))
        i = j
    return out, np.diff(ends)

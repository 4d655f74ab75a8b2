"""Vector text primitives: words of whole batches of documents as byte spans, and 64-bit hashes of spans."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LONG = 2048  # bytes beyond which a span is hashed on its own


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * _C3
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes (null: none) and each row's bounds in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    bufs = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with about `size` text bytes each; one longer text makes a range of its own."""
    for b in batches:
        _, offs = text_bytes(b.column(b.schema.get_field_index(column)))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which waits for other tasks, gives freed memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def padded(data: np.ndarray, lower: bool = False) -> np.ndarray:
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = LOWER[data] if lower else data
    return buf


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, starts and ends of the runs of bytes other than ASCII white space, and each row's bounds among the runs."""
    buf, n = padded(data, lower), len(data)
    word = ~SPACE[data]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    at = word.copy()
    at[1:] &= ~word[:-1]
    at[first] = word[first]
    starts = np.flatnonzero(at)
    at = word.copy()
    at[: n - 1] &= ~word[1:]
    at[last] = word[last]
    ends = np.flatnonzero(at) + 1
    return buf, starts, ends, np.searchsorted(starts, offs)


def loads(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every position of padded bytes, little-endian."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    v = loads(buf)
    n = ends - starts
    h = mix((v[starts] & _MASK[np.clip(n, 0, 8)]) + n.astype(np.uint64) * _C1)
    i = np.flatnonzero((n > 8) & (n <= LONG))
    p, left = starts[i] + 8, n[i] - 8
    while len(i):
        h[i] = mix(h[i] * _C1 + (v[p] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        i, p, left = i[more], p[more] + 8, left[more] - 8
    for k in np.flatnonzero(n > LONG):
        h[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]])
    return h


def combine(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        h = mix(h * _C1 + x)
    return h


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of one occurrence of each hash, and each occurrence's place among them."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place

"""Words and their hashes over whole Arrow batches of texts, without a Python step per word.

All functions work on UTF-8 bytes. A batch is cut into slices of bounded size, so memory follows the
slice (or one text, if that is longer), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 64

U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def byte_table(*excluded: range | int) -> np.ndarray:
    """True for the bytes of words: all but the excluded ones."""
    table = np.ones(256, dtype=bool)
    for x in excluded:
        table[np.array([x] if isinstance(x, int) else list(x))] = False
    return table


#: Words are runs without space, tab, line feed, vertical tab, form feed and carriage return.
BLANK_SEPARATED = byte_table(0x20, range(0x09, 0x0E))
#: Words are runs of digits, lower-case letters and anything outside ASCII (after lower_ascii).
ALPHANUMERIC = byte_table(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def releasing(run):
    """run, and after its last batch freed memory goes back to the system: Python workers stay on for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have at most limit bytes together (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them (rows + 1), without copying the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (rows + 1)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # words don't run on into the next row
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * _M2
    return h ^ (h >> U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sizes = ends - starts
    h = sizes.astype(U) * _M1 + U(seed)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    for at in range(0, LONG_WORD, 8):
        active = np.flatnonzero(sizes > at) if at else slice(None)
        if at and not len(active):
            break
        left = np.clip(sizes[active] - at, 0, 8).astype(U)
        lane = lanes[starts[active] + at] & (~U(0) >> ((U(8) - left) * U(8)))
        h[active] = mixed((h[active] ^ lane) * _M1)
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 and those across rows mean nothing."""
    if len(h) < n:
        return np.zeros(0, dtype=U)
    size, step, power, out, done, at = 1, h, int(_M1), None, 0, n
    # spans of 1, 2, 4, ... words; those of n's binary digits make up the whole
    while at:
        if at & 1:
            out = out[: len(step) - done] * U(power) + step[done:] if done else step
            done += size
        at >>= 1
        if at:
            step = step[:-size] * U(power) + step[size:]
            power = power * power % 2**64
            size *= 2
    return mixed(out[: len(h) - n + 1])


def fits(first: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether n words of its own row begin there (length: words - n + 1, or 0)."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(first[1:], np.diff(first))
    return (np.arange(total) + n <= ends)[: total - n + 1]


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U, copy=False).view(np.int64)

"""Vectorised words and word-sequence hashes over the UTF-8 buffer of an Arrow text column.

A word is a run of bytes outside a set of ASCII separators, so multi-byte characters never
break. Hashes are 64-bit polynomials over bytes (words) and over word hashes (sequences).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\v\f\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = 1 << 18
_LONG = 1 << 16
_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = 0xD6E8FEB86659FD93

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(int(_BYTE), _STEP + _LONG + 1)
_INV = _powers(pow(int(_BYTE), -1, 1 << 64), _STEP + _LONG + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: byte bounds, hashes, and for each text its first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than texts; text i has words first[i] to first[i+1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, blanks: bytes = BLANKS, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``."""
    is_word = np.ones(256, dtype=bool)
    is_word[list(blanks)] = False
    inside = is_word[data]
    n = len(data)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    del inside, before, after
    hashes = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + _STEP))
        lo, hi = start[i], min(end[j - 1], start[i] + _STEP + _LONG)
        part = data[lo:hi]
        part = (LOWER[part] if lower else part).astype(np.uint64)
        part += np.uint64(1)
        part *= _POW[: len(part)]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = start[i:j] - lo, np.minimum(end[i:j] - lo, hi - lo)
        hashes[i:j] = (total[e] - total[s]) * _INV[s]
        for k in np.flatnonzero(end[i:j] - start[i:j] > _LONG) + i:
            word = data[start[k]: end[k]]
            digest = hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest()
            hashes[k] = int.from_bytes(digest, "little")
        i = j
    return Words(start, end, mix(hashes + (end - start).astype(np.uint64)), np.searchsorted(start, offsets))


def sequence_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` values of ``h``, by doubling; runs may cross texts."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, done, power, width = None, 0, h, 1
    while width <= length:
        if length & width:
            part = power[done: done + n]
            total = part if total is None else total * np.uint64(pow(_WORD, width, 1 << 64)) + part
            done += width
        if width * 2 <= length:
            power = power[:-width] * np.uint64(pow(_WORD, width, 1 << 64)) + power[width:]
        width *= 2
    return mix(total + np.uint64(length))


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The task of ``mapInArrow``, releasing its memory at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size; one longer text makes a piece of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to

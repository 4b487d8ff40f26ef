"""Vectorised word scanning over the UTF-8 bytes of Arrow string columns.

The kernels here run inside Spark tasks. They look at a bounded slice of a batch at a time (``slices``), so
their memory follows the slice and never the partition.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1_000_000
HASH_BYTES = 1 << 18
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE2 = U64(0xD6E8FEB86659FD93)


def byte_table(separators: bytes) -> np.ndarray:
    """256 flags: True where a byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words are maximal runs without space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are maximal runs of 0-9, a-z and everything outside ASCII.
ALNUM = byte_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
    else:
        column = column.cast(pa.large_string())
        column = column.fill_null("") if column.null_count else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def release() -> None:
    """Gives freed memory back to the system; Spark keeps Python workers, and what they once used, between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that the last one took is given back before the next."""
    for b in batches:
        yield b
        del b
        release()


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one longer row makes a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of consecutive rows: byte ranges in ``data`` and the first word of every row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        lo = int(offsets[0])
        data = raw[lo : int(offsets[-1])]
        self.data = LOWER[data] if lower else data
        off = offsets - lo
        w = table[self.data]
        n = len(w)
        inside = np.zeros(n + 1, bool)  # byte i continues the word of byte i - 1
        np.logical_and(w[1:], w[:-1], out=inside[1:n])
        inside[off] = False
        self.starts = np.flatnonzero(w & ~inside[:n])
        self.ends = np.flatnonzero(w & ~inside[1:]) + 1
        self.first = np.searchsorted(self.starts, off)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, double: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``double`` mixes two independent polynomials, for use as an identity."""
        h = _poly(self.data, self.starts, self.ends, 0)
        if double:
            h = mix(h) ^ (_poly(self.data, self.starts, self.ends, 1) * U64(3))
        return mix(h ^ (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and the n + 1 places where they start."""
        size = self.ends - self.starts + 1
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        if not len(size):
            return np.zeros(0, np.uint8), at
        src = np.repeat(self.starts - at[:-1], size) + np.arange(at[-1])
        src[at[1:] - 1] = 0
        out = self.data[src]
        out[at[1:] - 1] = 32
        return out, at


@lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for ``HASH_BYTES`` places."""
    base = (_BASE, _BASE2)[which]
    out = []
    for b in (base, U64(pow(int(base), -1, 1 << 64))):
        p = np.full(HASH_BYTES, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def _poly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A polynomial of each word's bytes, whatever its place; ``HASH_BYTES`` of the data are looked at at a time."""
    power, inverse = _powers(which)
    out = np.zeros(len(starts), U64)
    a = 0
    while a < len(starts):
        at = int(starts[a])
        b = int(np.searchsorted(ends, at + HASH_BYTES, "right"))
        if b > a:
            part = data[at : int(ends[b - 1])]
            c = np.zeros(len(part) + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=c[1:])
            out[a:b] = (c[ends[a:b] - at] - c[starts[a:b] - at]) * inverse[starts[a:b] - at]
        else:  # one word longer than that
            b, total, scale = a + 1, 0, 1
            for i in range(at, int(ends[a]), HASH_BYTES):
                part = data[i : min(i + HASH_BYTES, int(ends[a]))]
                total += int(((part.astype(U64) + U64(1)) * power[: len(part)]).sum(dtype=U64)) * scale
                scale = scale * pow(int((_BASE, _BASE2)[which]), HASH_BYTES, 1 << 64) & (1 << 64) - 1
            out[a] = U64(total & (1 << 64) - 1)
        a = b
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive elements (n - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0x2545F4914F6CDD1D)
        out += h[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Index of the first word of each k-word window that stays in one row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return ragged(first[:-1], n)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges one after another."""
    return data[ragged(start, size)]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` (> 0) at a and at b hold equal bytes."""
    ok = np.ones(len(a), bool)
    step = 20_000
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        eq = gather(data, a[s], size[s]) == gather(data, b[s], size[s])
        ok[s] = np.logical_and.reduceat(eq, np.cumsum(size[s]) - size[s])
    return ok


def binary_array(data: np.ndarray, at: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """An Arrow column over ``data`` cut at the n + 1 offsets ``at``."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])

"""Vectorised work on UTF-8 text in Arrow batches: slices, words, hashes.

A batch is cut into slices of a few MB of text, so memory in a Python worker is
bounded by the slice (or by one document, where a document is longer). Hashes
are polynomials modulo 2**64 over per-byte random values, taken from one
running sum, and then mixed; they are the same on every machine.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc
except (OSError, AttributeError):
    _trim = None
SLICE_BYTES = (2 << 20) - 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor, shift, multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def byte_values(seed: int) -> np.ndarray:
    """256 fixed random 64-bit values."""
    return mix(mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(log_n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INV):
        p = np.ones(1 << log_n, U64)
        k = 1
        step = base
        while k < len(p):  # p[k:2k] = p[:k] * base**k
            np.multiply(p[:k], U64(step), out=p[k : 2 * k])
            step = step * step % (1 << 64)
            k *= 2
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 (at least) of the hash base and of its inverse."""
    return _powers(max(21, int(n - 1).bit_length()))


def tidy() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(f):
    """A batch function that gives the memory it has freed back to the system when its task ends: Python workers are
    used again by later tasks, and what they keep counts for the executor."""

    @functools.wraps(f)
    def run(*a, **k):
        try:
            yield from f(*a, **k)
        finally:
            tidy()

    return run


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    n = len(col)
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n and bufs[1] is not None else np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    if col.null_count:
        lens = np.diff(off)
        live = np.asarray(col.is_valid())
        if lens[~live].any():
            data = np.concatenate([data[off[i] : off[i + 1]] for i in np.flatnonzero(live)] or [np.zeros(0, np.uint8)])
            off = np.concatenate([[0], np.cumsum(np.where(live, lens, 0))]).astype(np.int64)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (a, b) holding at most that many bytes, or one row."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def text_slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets from 0) of each slice of a batch."""
    data, off = column_bytes(batch.column(name))
    for a, b in slices(off, most):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


class Words:
    """Words of a slice: starts and ends in bytes, 64-bit hashes, and the n+1 word offsets of its rows."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray, values: np.ndarray):
        """is_word: for each byte if words hold it; values: for each byte its value in the hash (fold case there)."""
        n = len(data)
        w = is_word[data]
        first = w.copy()
        first[1:] &= ~w[:-1]
        inner = off[(off > 0) & (off < n)]
        first[inner] = w[inner]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[inner - 1] = w[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(values[data] * p[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * inv[self.starts])
        self.rows = np.searchsorted(self.starts, off)

    def doc_ends(self) -> np.ndarray:
        """For each word the end, in words, of its row."""
        return np.repeat(self.rows[1:], np.diff(self.rows))


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (n-k+1 of them; none if there are fewer words)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = word_hash[:n].copy()
    for j in range(1, k):
        g *= U64(0xD6E8FEB86659FD93)
        g += word_hash[j : j + n]
    return mix(g + U64(k))

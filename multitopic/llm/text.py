"""Word tables of Arrow text columns, vectorised in NumPy.

A column is worked off in slices of whole rows holding about ``SLICE`` bytes,
so temporary arrays stay bounded by the slice (or by one longer text). Words
are maximal runs of word bytes; A-Z count as a-z. Because every byte of a
non-ASCII character is >= 0x80, the two word classes below mean the same on
UTF-8 bytes as on code points.

Word and shingle hashes have 64 bits: equality of hashes stands for equality
of words. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13 | 3  # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: byte values of the hashes: letters by case, and A-Z as a-z
CASED = _byte_table(20240501)
_TABLE = CASED[_LOWER]

#: words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n, kept for the next slice."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
                out = np.full(size, base & _MASK, dtype=np.uint64)
                out[0] = 1
                globals()[name] = np.cumprod(out, dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA3B195354A39B70D)
    return h ^ (h >> _U(32))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass
class Slice:
    """Rows ``lo..hi`` of a batch: their bytes and the row offsets in them."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.data[self.offs[i] : self.offs[i + 1]]


def slices(column, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string (or binary) column into slices of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, obuf, dbuf = column.buffers()
    offs = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None and dbuf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte range and hash of each, first word of each row
    (``rows`` has one entry more than there are rows)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray
    cum: np.ndarray

    def prefix_hash(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (the whole if shorter)."""
        return self.span_hash(self.start, np.minimum(self.end, self.start + size))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes ``start..end`` of the slice, for each pair."""
        with np.errstate(over="ignore"):
            return mix((self.cum[end] - self.cum[start]) * _inv[start])


def words(s: Slice, kind: np.ndarray, table: np.ndarray = _TABLE) -> Words:
    n = len(s.data)
    pw, iv = _powers(n + 1)
    inside = kind[s.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[s.offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    cum = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[s.data] * pw[:n], out=cum[1:])
        h = mix((cum[end] - cum[start]) * iv[start]) if n else np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, s.offs), cum)


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """The set of ``size``-word shingle hashes of each row, sorted by value;
    a row of fewer words has its whole sequence as its one shingle."""
    h = w.hash
    with np.errstate(over="ignore"):
        roll = h.copy()
        for k in range(1, size):
            roll = mix(roll[: len(h) - k] * _U(0x9E3779B97F4A7C15) + h[k:]) if len(h) > k else h[:0]
        out = []
        for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(roll[a : b - size + 1]))
            elif b > a:
                x = h[a : a + 1]
                for k in range(a + 1, b):
                    x = mix(x * _U(0x9E3779B97F4A7C15) + h[k : k + 1])
                out.append(x.copy())
            else:
                out.append(h[:0])
    return out

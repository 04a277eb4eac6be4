"""Vectorised views of a text column: bytes, words and their hashes.

Arrow hands a batch of strings over as one byte buffer with offsets; all
functions work on that buffer with numpy, so Python never loops over
characters.  Batches are cut into slices of a few MB, which bounds memory
whatever the batch size (one text longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20

#: The white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of letters: A-Z, a-z and all parts of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (in a new array)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def parts(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a text column."""
    data, off = utf8(column)
    for lo, hi in slices(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and of each text the index of its first word (len+1).

    ``inside``: for each byte whether it belongs to words; all but white space unless given.
    """
    solid = inside[data]
    before = np.empty(len(data), bool)
    before[1:], before[:1] = ~solid[:-1], True
    after = np.empty(len(data), bool)
    after[:-1], after[-1:] = ~solid[1:], True
    inner = off[(off > 0) & (off < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes, from which spans are hashed."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes from ``running()``; equal bytes give equal hashes anywhere."""
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts] + (ends - starts).astype(np.uint64))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _BASE
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as integers (their UTF-8 bytes side by side), and of each text the index of its first (len+1)."""
    inner = (data & 0xC0) == 0x80
    lead = np.flatnonzero(~inner)
    out = data[lead].astype(np.uint32)
    more = np.ones(len(lead), bool)
    for k in range(1, 4):
        at = np.minimum(lead + k, len(data) - 1)
        more &= (lead + k < len(data)) & inner[at]
        if not more.any():
            break
        out[more] = out[more] << np.uint32(8) | data[at[more]]
    return out, np.searchsorted(lead, off)


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of ``n`` characters."""
    m = max(0, len(chars) - n + 1)
    out = chars[:m] * np.uint32(0x9E3779B1)
    for j in range(1, n):
        out ^= out >> np.uint32(15)
        out = (out + chars[j : m + j]) * np.uint32(0x9E3779B1)
    return out

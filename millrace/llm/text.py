"""Byte-level helpers for Arrow text batches; small, and shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII letters, digits and everything outside ASCII (fixed by the word definition).
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that one numpy pass looks at; temporaries take some 60 times as much. UDFs are
#: marked as not deterministic, lest the planner evaluate one twice in a task.
PIECE = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)


def as_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 256), _MULT, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def _words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash (lower-cased) of each word; none crosses a break."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    kept = np.flatnonzero(inside)
    lens = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    rank = np.arange(len(kept)) - np.repeat(at, lens)
    power = _powers(int(lens.max()) + 1)
    value = (LOWER[data[kept]].astype(np.uint64) + np.uint64(1)) * power[rank]
    with np.errstate(over="ignore"):
        hashed = np.add.reduceat(value, at)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
    return starts, ends, hashed


def words_of(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: start, end, hash, and the n + 1 word offsets of the rows. A row of
    any length is taken in stretches of about ``limit`` bytes that end between words."""
    found = []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        while hi < n and WORD_BYTE[data[hi]] and WORD_BYTE[data[hi - 1]]:
            ahead = data[hi : hi + 4096]
            stop = np.flatnonzero(~WORD_BYTE[ahead])
            hi += int(stop[0]) if len(stop) else len(ahead)
        a, b = np.searchsorted(offsets, [lo, hi])
        s, e, h = _words_of(data[lo:hi], offsets[a:b] - lo)
        found.append((s + lo, e + lo, h))
        lo = hi
    if not found:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, ends, hashed, np.searchsorted(starts, offsets, "left")

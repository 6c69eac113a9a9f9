"""Vectorised word splitting and hashing over whole Arrow batches of UTF-8 text.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. All texts
of a batch are hashed together: one table look-up, one running sum and a handful of
numpy passes over the bytes, no Python loop over words or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: odd base of the running polynomial and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, _BLOCK)
_INVERSES = _powers(_INVERSE, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word crosses a text's border."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    end = ~space
    end[:-1] &= space[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(raw))]
    start[border] = ~space[border]
    end[border - 1] = ~space[border - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end): polynomial of byte codes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    scale = np.uint64(1)
    step = np.uint64(pow(_BASE, _BLOCK, 1 << 64))
    with np.errstate(over="ignore"):
        for k in range(0, len(raw), _BLOCK):
            piece = _BYTE_CODE[raw[k:k + _BLOCK]]
            piece *= _POWERS[:len(piece)]
            piece *= scale
            np.cumsum(piece, out=total[k + 1:k + 1 + len(piece)])
            total[k + 1:k + 1 + len(piece)] += total[k]
            scale *= step
        back = _INVERSES[starts & (_BLOCK - 1)] * _powers(pow(_INVERSE, _BLOCK, 1 << 64), (len(raw) >> 16) + 1)[starts >> 16]
        return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and n + 1 positions where each text's words begin."""
    raw, offsets = utf8_batch(column)
    if lower:
        raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


_ROLES = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                     0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(words: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles (repeats included) and n + 1 positions.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(at) - 1
    counts = np.diff(at)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    with np.errstate(over="ignore"):
        m = len(words) - size + 1
        rolled = np.zeros(max(m, 0), np.uint64)
        for k in range(size if m > 0 else 0):
            role = _ROLES[k] if k < len(_ROLES) else np.uint64(pow(_BASE, k + 1, 1 << 64))
            rolled += mix(words[k:k + m] * role) if k else words[:m] * role
        full = np.maximum(counts - size + 1, 0)
        short = (counts > 0) & (counts < size)
        sizes = np.where(short, 1, full)
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(out_at[-1], np.uint64)
        inside = np.repeat(at[:-1] - out_at[:-1], sizes) + np.arange(out_at[-1])
        whole = np.repeat(~short, sizes)
        out[whole] = rolled[inside[whole]]
        out = mix(out)
        for i in np.flatnonzero(short):  # at most size - 1 words each
            h = np.uint64(counts[i])
            for w in words[at[i]:at[i + 1]]:
                h = mix(np.asarray(h * _ROLES[0] + w))
            out[out_at[i]] = h
    return out, out_at


def slices(column: pa.Array, max_bytes: int = 2 << 20):
    """(first row, sub-array) pieces of at most ``max_bytes`` of text each, one longer text alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = utf8_batch(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, column.slice(first, last - first)
        first = last

"""Vectorised words and 64-bit word hashes over Arrow string columns.

A word is a maximal run of bytes of one class.  Its hash comes from a prefix
sum of ``code(byte) * P**i`` modulo 2**64, so all words of a slice are hashed
by a handful of NumPy passes instead of a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes hashed by one prefix sum.
_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: A random code for each byte value, made by the finaliser.
_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _BLOCK
    while size < n:
        size *= 2
    if size not in _powers:
        if size == _BLOCK or len(_powers) < 2:
            _powers[size] = (_cumulative(_P, size), _cumulative(_P_INV, size))
        else:
            return _cumulative(_P, size), _cumulative(_P_INV, size)
    return _powers[size]


def _cumulative(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word number.

    ``is_word`` tells for each byte value whether it belongs to words.  The
    third array has one entry more than there are rows.
    """
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]  # a word never crosses into the next row
    starts = np.flatnonzero(begins)
    ends_mask = ~inside
    ends_mask[cut] = True
    stops = np.flatnonzero(ends_mask)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are sorted and don't overlap."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        block = data[base : ends[to - 1]]
        power, inverse = _power_tables(len(block) + 1)
        prefix = np.zeros(len(block) + 1, dtype=U64)
        np.cumsum(_CODES[block] * power[: len(block)], out=prefix[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64)
        at = to
    return mix(out)


def word_class(*keep: tuple[int, int]) -> np.ndarray:
    """A table over byte values, true in the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in keep:
        out[a : b + 1] = True
    return out


#: Lower-cases the bytes A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~word_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM_LOWER = word_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive entries of ``first``; empty ones are zero."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full], axis=0, dtype=np.float64)
    return out


def gathered_sums(table: np.ndarray, codes: np.ndarray, first: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Sums of ``table[codes]`` by segment, gathered block by block."""
    out = np.zeros((len(first) - 1, *table.shape[1:]))
    for a in range(0, len(codes), block):
        b = min(a + block, len(codes))
        lo = max(0, int(np.searchsorted(first, a, side="right")) - 1)
        hi = int(np.searchsorted(first, b, side="left"))
        out[lo:hi] += segment_sums(table[codes[a:b]], np.clip(first[lo : hi + 1], a, b) - a)
    return out

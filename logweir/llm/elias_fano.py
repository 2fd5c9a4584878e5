"""Sorted integers in Elias-Fano form: about 2 + log2(largest / count) bits each, any one of them by select.

A value's low bits stand side by side in one bit string; the high parts are written in unary in another, where the bit of value i
is at (high part of i) + i. Every ``STEP``-th of these places is sampled as a 32-bit number, so the place of any value is found by
counting bits from the sample before it.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QBQQ")  # values, low bits, bytes of the low part, bytes of the high part
_BLOCK = 1 << 14


def packed(values: np.ndarray) -> bytes:
    """``values``: ascending, not negative, as unsigned 64-bit integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = b"".join(_low_bits(values[i : i + _BLOCK], width) for i in range(0, n, _BLOCK)) if width else b""
    places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    if places[-1] >= 1 << 32:
        raise ValueError("too many values for 32-bit samples")
    bits = np.zeros(int(places[-1]) + 1, np.uint8)
    bits[places] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    return _HEAD.pack(n, width, len(low), len(high)) + low + high + places[::STEP].astype("<u4").tobytes()


def _low_bits(values: np.ndarray, width: int) -> bytes:
    shifts = np.arange(width, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


class EliasFano:
    """Reads what ``packed`` wrote, without unfolding it."""

    def __init__(self, raw: bytes):
        self.size, self.width, low, high = _HEAD.unpack_from(raw)
        data, at = np.frombuffer(raw, np.uint8), _HEAD.size
        self.low, self.high = data[at : at + low], data[at + low : at + low + high]
        self.samples = np.frombuffer(raw, "<u4", -(-self.size // STEP), at + low + high)

    def __len__(self) -> int:
        return self.size

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        place, left = int(self.samples[i // STEP]), i % STEP
        if left:
            at = place // 8
            after = self.samples[i // STEP + 1] // 8 + 1 if i // STEP + 1 < len(self.samples) else len(self.high)
            region = self.high[at : int(after)].copy()
            region[0] &= 0xFF << place % 8 & 0xFF
            counts = np.cumsum(np.bitwise_count(region), dtype=np.int64)
            byte = int(np.searchsorted(counts, left, "right"))
            before = int(counts[byte - 1]) if byte else 0
            inside = np.flatnonzero(np.unpackbits(region[byte : byte + 1], bitorder="little"))[left - before]
            place = (at + byte) * 8 + int(inside)
        return (place - i << self.width) | int(self._lows(i, i + 1)[0])

    def values(self, first: int = 0, after: int | None = None) -> np.ndarray:
        """Values ``first`` to ``after`` - 1."""
        after = self.size if after is None else after
        if first >= after:
            return np.empty(0, np.uint64)
        base = first // STEP
        at = int(self.samples[base]) // 8
        last = -(-after // STEP)
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at:end], bitorder="little")
        bits[: int(self.samples[base]) - 8 * at] = 0
        places = np.flatnonzero(bits)[first - base * STEP : after - base * STEP] + 8 * at
        return ((places - np.arange(first, after)).astype(np.uint64) << np.uint64(self.width)) | self._lows(first, after)

    def _lows(self, first: int, after: int) -> np.ndarray:
        if not self.width:
            return np.zeros(after - first, np.uint64)
        out = np.empty(after - first, np.uint64)
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        for a in range(first, after, _BLOCK):
            b = min(after, a + _BLOCK)
            start, end = a * self.width, b * self.width
            bits = np.unpackbits(self.low[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start]
            out[a - first : b - first] = (bits.reshape(-1, self.width) * weights).sum(axis=1, dtype=np.uint64)
        return out

"""Elias-Fano coded ascending integers, searched without decoding the sequence."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(63)


class EliasFano:
    """n ascending uint64 values below a universe: `width` low bits each in a packed array, the high
    bits in unary in a bit vector of at most 3 n bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        # select directory: where each bucket of equal high bits begins
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        self.start = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int64)

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """n, width, low words and high bits."""
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        planes = []
        for at in range(0, n, 1 << 16):
            part = np.ascontiguousarray(values[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
            planes.append(np.unpackbits(part, axis=1, bitorder="little")[:, :width])
        bits = np.concatenate(planes).ravel() if planes else np.zeros(0, np.uint8)
        low = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")
        top = (values >> np.uint64(width)).astype(np.int64)
        flags = np.zeros(n + (int(top[-1]) if n else 0) + 2, np.uint8)
        flags[top + np.arange(n)] = 1
        return n, width, low, np.packbits(flags, bitorder="little")

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & _WORD
        value = self.low[word] >> shift
        carry = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & _WORD), np.uint64(0))
        return (value | carry) & np.uint64((1 << self.width) - 1)

    def successor(self, x: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of the first value that is at least x, within [first, last) where given."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        want = x & np.uint64((1 << self.width) - 1)
        known = len(self.start) - 1
        lo = np.where(high <= known, self.start[np.minimum(high, known)], self.n)
        hi = np.where(high + 1 <= known, self.start[np.minimum(high + 1, known)], self.n)
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        rows = np.flatnonzero(lo < hi)
        while len(rows):
            mid = (lo[rows] + hi[rows]) >> 1
            less = self._low(mid) < want[rows]
            lo[rows] = np.where(less, mid + 1, lo[rows])
            hi[rows] = np.where(less, hi[rows], mid)
            rows = rows[lo[rows] < hi[rows]]
        return lo

    def access(self, at: np.ndarray) -> np.ndarray:
        top = np.searchsorted(self.start, at, side="right") - 1
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._low(at)

"""Cuckoo filters over 128-bit keys: 16-bit fingerprints in buckets of four, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS, LOAD = 4, 0.85
_KICKS = 500
_TURN = np.uint64(0x5BD1E995)


def buckets_for(keys: int) -> int:
    """Buckets, a power of two, that hold so many keys at LOAD or less."""
    return 1 << max(0, (int(keys / (SLOTS * LOAD))).bit_length())


def _places(lo: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fingerprint (not zero) and both buckets of each key; mask: buckets less one."""
    lo = lo.view(np.uint64)
    mark = np.maximum(lo & np.uint64(0xFFFF), np.uint64(1))
    one = (lo >> np.uint64(16)) & mask
    return mark, one, one ^ ((mark * _TURN) & mask)


class Cuckoo:
    """One shard's filter. `full` once an insertion found no room; it must then be built anew."""

    def __init__(self, buckets: int, body: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if body is None else np.frombuffer(body, np.uint16).reshape(buckets, SLOTS).copy()
        self.full = False
        self._rng = np.random.default_rng(len(self.cells))

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.cells[bucket]
        for i in range(SLOTS):
            if not row[i]:
                row[i] = mark
                return True
        return False

    def insert(self, lo: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in _places(lo, self.mask))):
            if self._put(one, mark) or self._put(two, mark):
                continue
            at = one
            for slot in self._rng.integers(0, SLOTS, _KICKS).tolist():
                mark, self.cells[at, slot] = int(self.cells[at, slot]), mark
                at ^= int((np.uint64(mark) * _TURN) & self.mask)
                if self._put(at, mark):
                    break
            else:
                self.full = True
                return

    def remove(self, lo: np.ndarray) -> None:
        """Only keys that were inserted may be removed."""
        for mark, one, two in zip(*(x.tolist() for x in _places(lo, self.mask))):
            for bucket in (one, two):
                hit = np.flatnonzero(self.cells[bucket] == mark)
                if len(hit):
                    self.cells[bucket, hit[0]] = 0
                    break

    @classmethod
    def of(cls, lo: np.ndarray) -> Cuckoo:
        buckets = buckets_for(len(lo))
        while True:
            made = cls(buckets)
            made.insert(lo)
            if not made.full:
                return made
            buckets *= 2


class Filters:
    """The filters of many shards as one table; a shard without one may hold any key if it is `open`."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes | None]]):
        """rows: shard, body (None: any key may be in it); other shards hold nothing."""
        self.shards = shards
        sizes = np.ones(shards, np.int64)
        self.open, self.empty = np.zeros(shards, bool), np.ones(shards, bool)
        for s, body in rows:
            self.empty[s] = False
            self.open[s] = body is None
            sizes[s] = max(1, len(body or b"") // (2 * SLOTS))
        self.first = np.cumsum(sizes) - sizes
        self.mask = (sizes - 1).astype(np.uint64)
        self.cells = np.zeros((int(sizes.sum()), SLOTS), np.uint16)
        for s, body in rows:
            if body:
                self.cells[self.first[s] : self.first[s] + sizes[s]] = np.frombuffer(body, np.uint16).reshape(-1, SLOTS)

    def contain(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = hi % self.shards
        mark, one, two = _places(lo, self.mask[shard])
        first = self.first[shard]
        hit = (self.cells[first + one.astype(np.int64)] == mark[:, None]).any(axis=1)
        hit |= (self.cells[first + two.astype(np.int64)] == mark[:, None]).any(axis=1)
        return (hit & ~self.empty[shard]) | self.open[shard]

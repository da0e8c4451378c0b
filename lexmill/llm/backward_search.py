"""Equal fixed-length strings of a text by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _turned(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The order of rows by keys (values, bits of each), the first key first. Where they fit into 64
    bits with the row's number, the packed values are sorted, which is faster than an indirect sort."""
    n = len(keys[0][0])
    bits = n.bit_length()
    packed = np.zeros(n, np.uint64)
    for values, width in keys:
        packed = (packed << np.uint64(width)) | values.astype(np.uint64)
    if sum(w for _, w in keys) + bits > 64:
        return np.argsort(packed)
    packed = (packed << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in ascending order, by prefix doubling from 4 bytes on; only
    suffixes that still tie are sorted again. The text's last byte must be its largest."""
    n = len(text)
    key = np.ndarray((n,), ">u4", text.tobytes() + bytes(4), strides=(1,)).astype(np.uint32)
    order = _turned((key, 32))
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    new = new[slots]
    step = 4
    while len(slots):
        at = order[slots]
        group = np.cumsum(new)
        later = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        turn = _turned((group, int(group[-1]).bit_length()), (later, n.bit_length()))
        at, group, later = at[turn], group[turn], later[turn]
        order[slots] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (later[1:] != later[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = ~(new & np.append(new[1:], True))
        slots, new = slots[tied], new[tied]
        step *= 2
    return order


def smallest_owner(text: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int, first: int = 8) -> np.ndarray:
    """For each window (the `length` bytes before an end) the smallest owner of an equal window.

    Breadth first: at common prefix length k the live windows are grouped by the rows of the
    transform whose suffixes begin k bytes before the windows' ends, one interval of rows for each
    distinct string of k bytes. One backward step (the LF mapping) extends all intervals by all
    characters at once; an interval splits where the characters differ. Intervals of one window are
    settled and leave. The first 8 values are read from packed keys, and expansion stops at `length`.
    """
    best = owner.copy()
    if len(ends) < 2:
        return best
    n = len(text)
    order = np.concatenate([[n], suffix_order(text)])  # the empty suffix comes first
    row = np.empty(n + 1, np.int64)
    row[order] = np.arange(n + 1)
    bwt = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
    lf = np.empty(n + 1, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n + 1)
    initial = np.concatenate([[0], text[order[1:]]]).astype(np.uint8)  # first character of each row's suffix
    del order, bwt
    rows = row[ends - first]
    del row
    turn = _turned((rows, (n + 1).bit_length()))
    rows, live = rows[turn], turn
    key = np.ndarray((n - 7,), ">u8", text.tobytes(), strides=(1,))[ends[live] - first]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for k in range(first, length + 1):
        if k > first:
            rows = lf[rows]
            turn = _turned((rows, (n + 1).bit_length()))
            rows, live, group = rows[turn], live[turn], group[turn]
            char = initial[rows]
            new = np.concatenate([[True], (char[1:] != char[:-1]) | (group[1:] != group[:-1])])
        shared = ~(new & np.append(new[1:], True))
        rows, live, new = rows[shared], live[shared], new[shared]
        if not len(live):
            return best
        group = np.cumsum(new)
    starts = np.flatnonzero(new)
    best[live] = np.repeat(np.minimum.reduceat(owner[live], starts), np.diff(starts, append=len(live)))
    return best

"""Ids of whole texts by way of their distinct units.

A unit starts at every place where a byte-level BPE pattern always starts a piece: at ASCII white
space after a character that is none, and at an ASCII non-letter after a letter. The tokenizer's own
cuts never cross a unit, so a unit's ids do not depend on its neighbours. The places are found on the
texts' bytes; each distinct unit of some megabytes is looked up in a bounded memo once.

A memo is bounded in units and in the length of a unit; longer ones are encoded anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .blocks import give_back

#: A space and letters of ASCII and Latin-1 (two bytes from 0xC3): one piece of the pattern.
PLAIN_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
SLICE_BYTES = 4 << 20
_WHITE, _LETTER, _OTHER = 1, 2, 3  # 0: not ASCII
_KIND = np.array(
    [0 if b > 127 else _WHITE if b in b" \t\n\v\f\r" else _LETTER if bytes([b]).isalpha() else _OTHER for b in range(256)], np.uint8
)
_LONG = 64


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each byte."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
    before, here = kind[:-1], kind[1:]
    cut = np.ones(len(raw), bool)
    cut[1:] = ((here == _WHITE) & (before >= _LETTER)) | ((here == _OTHER) & (before == _LETTER))
    return cut


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text ends in them."""
    column = column.cast(pa.binary())
    offsets, body = column.buffers()[1:]
    if not len(column) or body is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(body, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


class Memo:
    """Ids of texts as unsigned 32-bit integers, with a bounded memo of units."""

    def __init__(self, encode_units: Callable[[list[bytes]], list[bytes]], added: dict[str, int], limit: int = 200_000):
        self.encode_units, self.limit, self.known, self.older = encode_units, limit, {}, {}
        self.added = {s.encode(): np.array([i], "<u4") for s, i in added.items()}
        each = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, each)) + b")") if added else None

    def _unit_ids(self, units: list[bytes]) -> list[bytes]:
        """Two generations: what the older one has moves to the younger."""
        ids = list(map(self.known.get, units))
        gaps = [i for i, x in enumerate(ids) if x is None]
        new = []
        for i in gaps:
            ids[i] = self.older.get(units[i])
            if ids[i] is None:
                new.append(i)
        for i, x in zip(new, self.encode_units([units[i] for i in new])):
            ids[i] = x
        learnt = {units[i]: ids[i] for i in gaps if len(units[i]) <= _LONG}
        if len(self.known) + len(learnt) > self.limit:
            self.known, self.older = {}, self.known
        self.known.update(learnt)
        return ids

    def _plain(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        cut = unit_starts(raw)
        cut[starts[starts < ends]] = True
        at = np.flatnonzero(cut)
        places = np.append(at, len(raw)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._unit_ids(units.dictionary.to_pylist()), pa.binary()).take(units.indices)
        reach = np.frombuffer(ids.buffers()[1], np.int32)[: len(at) + 1]
        flat = np.frombuffer(ids.buffers()[2], np.uint8)[: reach[-1]].view("<u4")
        first = np.append(np.searchsorted(at, starts), len(at))
        return flat, np.diff(reach[first].astype(np.int64)) // 4

    def _with_added(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands between the strings of added tokens is encoded on its own."""
        body = raw.tobytes()
        cuts = [[x for x in self.cut.split(body[a:b]) if x] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        plain = [x for c in cuts for x in c if x not in self.added]
        flat, sizes = self._plain(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([len(x) for x in plain], dtype=np.int64))
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if plain else ())
        out = [np.concatenate([self.added[x] if x in self.added else next(parts) for x in c] or [flat[:0]]) for c in cuts]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def slices(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As `encode`, for some megabytes of texts at a time."""
        raw, ends = text_bytes(column)
        row = begin = 0
        while row < len(ends):
            stop = max(row + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
            part, reach = raw[begin : ends[stop - 1]], ends[row:stop] - begin
            some = part.tobytes() if self.added else b""
            yield (self._with_added if any(a in some for a in self.added) else self._plain)(part, reach)
            row, begin = stop, int(ends[stop - 1])
        give_back()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column's texts one after another, and how many each has."""
        each = list(self.slices(column))
        none = (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        flat, sizes = zip(*each) if each else ([none[0]], [none[1]])
        return np.concatenate(flat), np.concatenate(sizes)


def with_end(flat: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text."""
    return np.insert(flat, np.cumsum(sizes), end_id), sizes + 1


def id_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of int32."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view("<i4")))


def ids_of_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The way back; a null list is an empty one."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), sizes


def split_ids(flat: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
    """Each text's ids as bytes."""
    body, ends = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B") if len(flat) else memoryview(b""), (np.cumsum(sizes) * 4).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends)]

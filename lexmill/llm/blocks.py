"""Blocks: some megabytes of documents as one row with packed arrays.

Operators that ask about many keys of each document gather documents into blocks, ask for each
block's distinct keys (a combine before the shuffle), deal the questions to shards by ranges of a
hash, and bring the answers back to the block. Arrays are packed as byte planes under zstandard.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext

BLOCK_BYTES = 12 << 20


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns what a Python worker no longer uses to the system: workers serve one stage after another, and
    memory that a batch has left behind would count against the executor in the next."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(body: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """An ascending uint64 array as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body, np.uint64), dtype=np.uint64)


def gathered_tables(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """block id and rows of about `limit` bytes; the second column is the text. The ids are unique
    within one run of the query; they are fixed by writing the blocks before they are used."""
    part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        at = 0
        lengths = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
        reach = np.cumsum(lengths)
        while at < b.num_rows:
            before = reach[at - 1] if at else 0
            end = min(b.num_rows, int(np.searchsorted(reach, before + limit - size)) + 1)
            rows.append(b.slice(at, end - at))
            size += int(reach[end - 1] - before)
            at = end
            if size >= limit:
                yield part << 32 | seq, pa.Table.from_batches(rows)
                seq, rows, size = seq + 1, [], 0
    if rows:
        yield part << 32 | seq, pa.Table.from_batches(rows)


def utf8(column: pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[bytes]]]:
    """block id, doc_ids and texts as UTF-8 of rows doc_id, text."""
    for block, rows in gathered_tables(batches, limit):
        yield block, rows.column(0).to_pylist(), utf8(rows.column(1))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards as equal ranges of 64-bit keys, so that ascending keys lie shard by shard."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def slices(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the runs in an ascending array of shards."""
    if not len(shard):
        return []
    cut = np.flatnonzero(np.diff(shard)) + 1
    starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(shard)]
    return [(int(shard[a]), a, b) for a, b in zip(starts, ends)]


def parts(count: int, each: int) -> int:
    return max(1, -(-int(count) // each))

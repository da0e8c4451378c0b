"""Edges as packed blocks, and one hop of many seeds over them.

A block holds the distinct edges of a range of their `dst`, about EDGES_A_BLOCK of them, as one row: sorted, as differences, by
byte planes under zstandard. That is about two bytes an edge, so blocks can be shuffled in every hop where edges can
not. Nodes of the frontier are sent to the blocks that hold them, in whichever place of an edge, and what an edge carries over is
combined within the block: a neighbour leaves it once for each word of seeds, not once for each edge. A `dst` with more edges than
a block is dealt over several by `src`; which block has an edge never changes what a hop finds.

Defined cases: ids are integers of any width; an edge counts once and in both directions; a null end can be reached and leads nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

EDGES_A_BLOCK = 1_000_000
LINKS_AT_ONCE = 2_000_000
#: `blind` has the nodes with an edge whose other end is null.
_ROW = pa.schema({"block": pa.int32(), "n": pa.int64(), "src": pa.binary(), "dst": pa.binary(), "blind": pa.list_(pa.int64())})
_KIND = "block int, n long, src binary, dst binary, blind array<long>"
_HOP = pa.schema({"node": pa.int64(), "word": pa.int64(), "got": pa.int64()})


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(body, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()


def _distinct(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges by dst, then src, each once."""
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    first = np.ones(len(src), bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    return src[first], dst[first]


def _row(block: int, src: np.ndarray, dst: np.ndarray, blind: np.ndarray) -> dict:
    """A row of edges in the order of _distinct."""
    return {"block": block, "n": len(src), "src": _pack(src), "dst": _pack(np.diff(dst, prepend=0)), "blind": blind}


def _edges(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst and blind of all rows together."""
    src, dst, blind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows.select(["n", "src", "dst", "blind"]).to_pylist():
        src.append(_unpack(r["src"], r["n"]))
        dst.append(np.cumsum(_unpack(r["dst"], r["n"])))
        blind.append(np.array(r["blind"], np.int64))
    return np.concatenate(src), np.concatenate(dst), np.concatenate(blind)


def _dealt(bounds: list[int]):
    """Packs the edges of a task by blocks, LINKS_AT_ONCE edges at a time."""
    at = np.array(bounds, np.int64)

    def block(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(at, dst, side=s) for s in ("left", "right"))
        mixed = (src.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return low + mixed.view(np.int64) % (high - low + 1)

    def cut(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        no_src, no_dst = (t[c].is_null().to_numpy() for c in ("src", "dst"))
        src, dst = (t[c].combine_chunks().fill_null(0).to_numpy() for c in ("src", "dst"))
        blind = np.unique(np.concatenate((src[no_dst & ~no_src], dst[no_src & ~no_dst])))
        src, dst = _distinct(src[~no_src & ~no_dst], dst[~no_src & ~no_dst])
        of, of_blind = block(src, dst), block(blind, blind)
        order = np.argsort(of, kind="stable")
        src, dst, of = src[order], dst[order], of[order]
        rows = []
        for k in np.union1d(of, of_blind).tolist():
            mine = slice(*np.searchsorted(of, (k, k + 1)))
            rows.append(_row(k, src[mine], dst[mine], blind[of_blind == k]))
        return pa.RecordBatch.from_pylist(rows, schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= LINKS_AT_ONCE:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    return run


def _merged(rows: pa.Table) -> pa.Table:
    src, dst, blind = _edges(rows)
    return pa.Table.from_pylist([_row(rows["block"][0].as_py(), *_distinct(src, dst), np.unique(blind))], schema=_ROW)


def blocks(edges: DataFrame) -> DataFrame:
    """One row for each block of the edges (src, dst)."""
    for c in ("src", "dst"):
        if not isinstance(edges.schema[c].dataType, IntegralType):
            raise TypeError(f"{c} must be an integer, not {edges.schema[c].dataType.simpleString()}")
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    n = -(-rows.count() // EDGES_A_BLOCK)
    bounds = rows.agg(F.percentile_approx("dst", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    return rows.mapInArrow(_dealt(bounds or []), _KIND).groupBy("block").applyInArrow(_merged, _KIND)


def places(packed: DataFrame) -> DataFrame:
    """node, block: which blocks hold a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                nodes = np.unique(np.concatenate(_edges(b.slice(i, 1))))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), b["block"][i].as_py(), np.int32))], names=["node", "block"])

    return packed.mapInArrow(run, "node long, block int")


def _carried(asked: pa.Table, block: pa.Table, both: np.ufunc = np.bitwise_or) -> pa.Table:
    """node, word, got: the neighbours within a block and the masks that reach them, put together by `both`."""
    out = []
    if asked.num_rows and block.num_rows:
        src, dst, blind = _edges(block)
        nodes, place = np.unique(np.concatenate((src, dst, blind)), return_inverse=True)
        src, dst = place[: len(src)], place[len(src) : 2 * len(src)]
        near = np.concatenate((src, dst))
        far = np.concatenate((dst, src))[np.argsort(near, kind="stable")]
        begin = np.concatenate(([0], np.cumsum(np.bincount(near, minlength=len(nodes)))))
        word, node, mask = (asked[c].to_numpy() for c in ("word", "node", "mask"))
        order = np.argsort(word, kind="stable")
        word, node, mask = word[order], node[order], mask[order]
        at = np.searchsorted(nodes, node)
        links = begin[at + 1] - begin[at]
        reach = np.cumsum(links)
        cuts = np.unique(np.searchsorted(reach, np.arange(LINKS_AT_ONCE, reach[-1], LINKS_AT_ONCE)))
        for some in np.split(np.arange(len(at)), cuts):
            n = links[some]
            if not n.sum():
                continue
            each = np.repeat(some, n)
            to = far[np.arange(len(each)) + np.repeat(begin[at[some]] - np.cumsum(n) + n, n)]
            words, no = np.unique(word[some], return_inverse=True)
            key = np.repeat(no, n) * len(nodes) + to
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            got = both.reduceat(mask[each[order]], heads)
            out.append(pa.table([pa.array(nodes[key[heads] % len(nodes)]), pa.array(words[key[heads] // len(nodes)]), pa.array(got)], schema=_HOP))
        if (sees := np.isin(node, blind)).any():
            words, heads = np.unique(word[sees], return_index=True)
            got = both.reduceat(mask[sees], heads)
            out.append(pa.table([pa.nulls(len(words), pa.int64()), pa.array(words), pa.array(got)], schema=_HOP))
    return pa.concat_tables(out) if out else _HOP.empty_table()


def hop(front: DataFrame, packed: DataFrame, held: DataFrame, both: np.ufunc = np.bitwise_or) -> DataFrame:
    """node, word, got: where the masks of the frontier (node, word, mask) lead in one hop over packed blocks whose nodes' places are
    held; a node and word can come from several blocks."""

    def carried(asked: pa.Table, block: pa.Table) -> pa.Table:
        return _carried(asked, block, both)

    asked = front.join(held, "node").select("block", "node", "word", "mask")
    return asked.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(carried, "node long, word long, got long")


def kin(nodes: DataFrame, packed: DataFrame, held: DataFrame) -> DataFrame:
    """node, least: the least of the nodes that share a neighbour with each."""
    front = nodes.select("node", F.lit(0).cast("long").alias("word"), F.col("node").alias("mask"))
    for _ in range(2):
        front = hop(front, packed, held, np.minimum).groupBy("node", "word").agg(F.min("got").alias("mask"))
    return nodes.join(front.select("node", F.col("mask").alias("least")), "node", "left")

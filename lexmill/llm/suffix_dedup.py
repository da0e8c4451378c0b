"""Exact substring deduplication across documents.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller
doc_id. Equal strings must meet without a suffix array of the whole corpus:

1. Every window of `length` bytes has a key, the smallest hash among its k-byte strings. The key is
   a function of the window alone, so equal windows share it, and neighbouring windows form runs of
   one key. Blocks of documents ask shards (ranges of keys) which keys stand in several documents.
2. Runs of such keys are sent as segments (the bytes of all their windows), each distinct one once
   for a block with its smallest doc_id. A shard concatenates its distinct segments and finds equal
   windows by threshold-bounded interval expansion on their Burrows-Wheeler transform.
3. The smallest doc_id of each window returns to the block, which marks the bytes.

A key that stands in HOT or more documents would gather in one shard: its windows are sent one by
one and dealt by their own hash instead. Nothing is capped; a shard's size is bounded by their number.

Defined cases: a null or empty text has no bytes and no removals; a null doc_id is larger than all
others, and rows of equal doc_ids never remove each other's bytes; an empty table gives an empty
result; other columns are ignored by `measure` and kept by `remove`. doc_ids are integers below 2**63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backward_search import smallest_owner
from .blocks import gathered_tables, give_back, pack, pack_sorted, parts, shard_of, slices, unpack, unpack_sorted, utf8
from .shared import materialize, table, texts

LENGTH = 50
HOT = 20_000
KEYS_A_SHARD = 2_000_000
SEGMENTS_A_SHARD = 40_000
BLOCK_BYTES = 5 << 20  # a block and its segments are held several times over
_CHUNK = 1 << 18
_RUN = 256  # longer runs are cut
_NOBODY = np.iinfo(np.int64).max
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SEPARATOR = 0xFF  # in no UTF-8 text


def _hashes(body: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string (k at least 8)."""
    n = len(body) - k + 1
    word = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,)).copy()
    h = word[:n] * _ODD[0]
    for i, at in enumerate([*range(8, k - 8, 8), k - 8]):
        h ^= h >> np.uint64(31)
        h += word[at : at + n] * _ODD[1 + i % 3]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def window_runs(body: bytes, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, start, number of windows, document of each run; runs do not cross documents."""
    k = 24 if length >= 48 else max(8, length // 2)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[tuple] = []
    doc = 0
    while doc < len(sizes):
        stop = max(doc + 1, int(np.searchsorted(ends, starts[doc] + _CHUNK, side="right")))
        base, top = int(starts[doc]), int(ends[stop - 1])
        if top - base >= length:
            low = _sliding_min(_hashes(body[base:top], k), length - k + 1)
            valid = np.zeros(len(low), bool)
            begin = np.zeros(len(low), bool)
            owner = np.zeros(len(low), np.int64)
            for d in range(doc, stop):
                if sizes[d] >= length:
                    a, b = int(starts[d]) - base, int(ends[d]) - base - length + 1
                    valid[a:b], begin[a], owner[a:b] = True, True, d
            begin[1:] |= (low[1:] != low[:-1]) & valid[1:]
            begin |= valid & (np.arange(len(low)) % _RUN == 0)
            at = np.flatnonzero(begin)
            # a run ends where the next begins or where its document's windows end
            last = np.flatnonzero(valid & ~np.append(valid[1:] & ~begin[1:], False)) + 1
            out.append((low[at], at + base, last - at, owner[at]))
        doc = stop
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, start, count, owner = (np.concatenate(x) for x in zip(*out))
    key = key * _ODD[0]  # smallest hashes are small: spread them over the shards' ranges
    key ^= key >> np.uint64(32)
    return key * _ODD[2], start, count, owner


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of rows doc_id, text and whatever else, in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for block, rows in gathered_tables(batches, BLOCK_BYTES):
            rows = rows.take(pa.compute.sort_indices(rows.column(0)))  # nulls last
            bodies = utf8(rows.column(1))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.drop_columns("text").schema) as w:
                w.write_table(rows.drop_columns("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([pack(np.fromiter(map(len, bodies), np.int64, len(bodies)))]),
                    pa.array([squeeze.compress(b"".join(bodies))]), pa.array([squeeze.compress(sink.getvalue().to_pybytes())]),
                    pa.array([sum(map(len, bodies))]),
                ],
                names=["block", "sizes", "body", "rest", "n_bytes"],
            )

    return docs.mapInArrow(run, "block bigint, sizes binary, body binary, rest binary, n_bytes bigint")


def _open(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, pa.Table]:
    """body, sizes, doc_ids (a null one last of all), other columns."""
    squeeze = zstandard.ZstdDecompressor()
    rest = pa.ipc.open_stream(squeeze.decompress(row["rest"])).read_all()
    ids = rest.column(0).fill_null(_NOBODY).to_numpy()
    return squeeze.decompress(row["body"]), unpack(row["sizes"], np.int64), ids, rest


def shared_keys(blocks: DataFrame, shards: int, length: int, hot: int) -> DataFrame:
    """shard, block, answer: 0 for a block's key in one document, 1 in several, 2 in `hot` or more."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                body, sizes, _, _ = _open(row)
                key, _, _, doc = window_runs(body, sizes, length)
                turn = np.argsort(key, kind="stable")
                key, doc = key[turn], doc[turn]
                new = np.diff(key, prepend=~key[:1]) != 0
                first = np.flatnonzero(new)
                docs = np.add.reduceat(new | (np.diff(doc, prepend=-1) != 0), first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
                key = key[first]
                rows = [(s, row["block"], pack_sorted(key[i:j]), pack(docs[i:j])) for s, i, j in slices(shard_of(key, shards))]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "block", "keys", "docs"])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.select(["keys", "docs"]).to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        docs = np.bincount(place, np.concatenate([unpack(r["docs"], np.uint32) for r in rows]), len(distinct))
        code = ((docs > 1).astype(np.uint8) + (docs >= hot))[place]
        ends = np.cumsum([len(k) for k in keys])
        each = [code[e - len(k) : e] for k, e in zip(keys, ends)]
        return pa.table({
            "shard": group.column("shard"), "block": group.column("block"), "answer": pa.array([pack(x) for x in each], pa.binary()),
            "segments": pa.array([int((x > 0).sum()) for x in each], pa.int64()),
        })

    asked = blocks.mapInArrow(ask, "shard bigint, block bigint, keys binary, docs binary")
    return asked.groupBy("shard").applyInArrow(answer, "shard bigint, block bigint, answer binary, segments bigint")


class Segments:
    """A block's distinct segments, in the order in which shards are asked."""

    def __init__(self, body: bytes, sizes: np.ndarray, ids: np.ndarray, codes: list[bytes], shards: int, length: int):
        key, start, count, doc = window_runs(body, sizes, length)
        code = np.concatenate([unpack(c, np.uint8) for c in codes] + [np.zeros(0, np.uint8)])
        code = code[np.unique(key, return_inverse=True)[1]] if len(key) else code
        cold, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        # a hot run's windows stand alone
        alone = np.repeat(start[hot], count[hot]) + np.arange(count[hot].sum()) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
        self.start = np.concatenate([start[cold], alone])
        self.count = np.concatenate([count[cold], np.ones(len(alone), np.int64)])
        self.doc = np.concatenate([doc[cold], np.repeat(doc[hot], count[hot])])
        by_doc = np.argsort(self.doc, kind="stable")  # so the first of equal segments has the smallest doc_id
        self.start, self.count, self.doc = self.start[by_doc], self.count[by_doc], self.doc[by_doc]
        is_cold = by_doc < len(cold)
        known: dict[bytes, int] = {}
        self.place = np.fromiter(
            (known.setdefault(body[a:b], len(known)) for a, b in zip(self.start.tolist(), (self.start + self.count + length - 1).tolist())),
            np.int64, len(self.start),
        )
        self.parts = list(known)
        _, first = np.unique(self.place, return_index=True)
        deal = np.empty(len(first), np.uint64)
        mine = is_cold[first]
        deal[mine] = key[cold][by_doc[first[mine]]]
        deal[~mine] = [xxhash.xxh64_intdigest(self.parts[i]) for i in np.flatnonzero(~mine)]
        self.owner, self.windows = ids[self.doc[first]], self.count[first]
        self.shard = shard_of(deal, shards)
        self.order = np.argsort(self.shard, kind="stable")


def _split(got: pa.Table, kind: int) -> list[bytes]:
    rows = sorted((r["shard"], r["answer"]) for r in got.to_pylist() if r["kind"] == kind)
    return [a for _, a in rows]


def smallest_ids(blocks: DataFrame, codes: DataFrame, shards: int, length: int) -> DataFrame:
    """shard, block, answer: the smallest doc_id of each window of a block's segments."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names, squeeze, rows = ("shard", "block", "counts", "owners", "body"), zstandard.ZstdCompressor(level=1), []
        for row in left.to_pylist():
            body, sizes, ids, _ = _open(row)
            own = Segments(body, sizes, ids, _split(right, 1), shards, length)
            for s, i, j in slices(own.shard[own.order]):
                some = own.order[i:j]
                rows.append((s, row["block"], pack(own.windows[some]), pack(own.owner[some]), squeeze.compress(b"".join(own.parts[x] for x in some))))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
        give_back()
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def answer(group: pa.Table) -> pa.Table:
        rows, squeeze = group.select(["counts", "owners", "body"]).to_pylist(), zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        places, owners, counts = [], [], []
        for r in rows:
            body, count = squeeze.decompress(r["body"]), unpack(r["counts"], np.int64)
            ends = np.cumsum(count + length - 1)
            places.append(np.fromiter(
                (known.setdefault(body[a:b], len(known)) for a, b in zip((ends - count - length + 1).tolist(), ends.tolist())), np.int64, len(count)
            ))
            owners.append(unpack(r["owners"], np.int64))
            counts.append(count)
        place = np.concatenate(places)
        owner = np.full(len(known), _NOBODY)
        np.minimum.at(owner, place, np.concatenate(owners))
        sep = bytes([_SEPARATOR])
        text = np.frombuffer(sep.join(known) + sep, np.uint8)
        size = np.fromiter(map(len, known), np.int64, len(known))
        known.clear()
        windows = size - length + 1
        first = np.cumsum(size + 1) - size - 1
        offset = np.cumsum(windows) - windows
        ends = np.arange(windows.sum()) + np.repeat(first - offset + length, windows)
        best = smallest_owner(text, ends, np.repeat(owner, windows), length)
        out = []
        for p, c in zip(places, counts):
            begin = np.cumsum(c) - c
            out.append(pack(best[np.arange(c.sum()) + np.repeat(offset[p] - begin, c)]))
        del best, text, ends, places
        give_back()
        return pa.table({"shard": group.column("shard"), "block": group.column("block"), "answer": pa.array(out, pa.binary())})

    asked = blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(
        ask, "shard bigint, block bigint, counts binary, owners binary, body binary"
    )
    return asked.groupBy("shard").applyInArrow(answer, "shard bigint, block bigint, answer binary")


def _covered(row: dict, right: pa.Table, shards: int, length: int):
    """body, sizes, ids, other columns, and which bytes go."""
    body, sizes, ids, rest = _open(row)
    own = Segments(body, sizes, ids, _split(right, 1), shards, length)
    got = np.concatenate([unpack(a, np.int64) for a in _split(right, 2)] + [np.zeros(0, np.int64)])
    asked = own.windows[own.order]
    offset = np.empty(len(asked), np.int64)
    offset[own.order] = np.cumsum(asked) - asked
    total = own.count.sum()
    within = np.arange(total) - np.repeat(np.cumsum(own.count) - own.count, own.count)
    smallest = got[np.repeat(offset[own.place], own.count) + within]
    gone = (np.repeat(own.start, own.count) + within)[smallest < np.repeat(ids[own.doc], own.count)]
    step = np.bincount(gone, minlength=len(body) + 1) - np.bincount(gone + length, minlength=len(body) + 1)
    return body, sizes, ids, rest, np.cumsum(step[: len(body)]) > 0


def _answered(docs: DataFrame, length: int, hot: int):
    blocks = materialize(text_blocks(docs), "text-blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    codes = materialize(shared_keys(blocks, parts(n_bytes // 13, KEYS_A_SHARD), length, hot), "shared-keys")
    shards = parts(codes.agg(F.sum("segments")).first()[0] or 0, SEGMENTS_A_SHARD)
    # the blocks are shuffled by block once for both of their uses below
    left = blocks.select("block", "sizes", "body", "rest")
    codes = codes.select("block", F.lit(1).alias("kind"), "shard", "answer")
    ids = smallest_ids(left, codes, shards, length).select("block", F.lit(2).alias("kind"), "shard", "answer")
    return left, codes.union(ids), shards


def measure(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    left, answers, shards = _answered(texts(docs).select(F.col("doc_id").cast("long"), "text"), length, hot)

    def finish(one: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = one.to_pylist()
        body, sizes, _, rest, gone = _covered(row, right, shards, length)
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(gone)])
        opens = gone & ~np.concatenate([[False], gone[:-1]])
        at = (ends - sizes)[sizes > 0]
        opens[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(opens)])
        raw, sha = np.frombuffer(body, np.uint8), []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            kept = body[a:b] if total[a] == total[b] else raw[a:b][~gone[a:b]].tobytes()
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.table({
            "doc_id": rest.column(0), "n_bytes": sizes, "n_removed": total[ends] - total[ends - sizes],
            "n_spans": spans[ends] - spans[ends - sizes], "kept_sha256": sha,
        })

    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents, all rows and columns, without those bytes; n_chars follows where it is present.
    A character of which only some bytes would go stays whole. A null text stays null."""
    names, schema = docs.columns, docs.schema
    # what is not text travels in one column, so that no name can clash and no type changes
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("null"), row.alias("row"))
    left, answers, shards = _answered(rows, length, hot)

    def finish(one: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = one.to_pylist()
        body, sizes, _, rest, gone = _covered(row, right, shards, length)
        raw = np.frombuffer(body, np.uint8)
        if len(raw):
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(lead, append=len(raw)))
        ends, text = np.cumsum(sizes), []
        for a, b, null in zip((ends - sizes).tolist(), ends.tolist(), rest.column("null").to_pylist()):
            text.append(None if null else raw[a:b][~gone[a:b]].tobytes().decode())
        others = rest.column("row").combine_chunks()
        out = {c: others.field(c) for c in names if c != "text"} | {"text": pa.array(text, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in text]).cast(out["n_chars"].type)
        return pa.table([out[c] for c in names], names=names)

    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))

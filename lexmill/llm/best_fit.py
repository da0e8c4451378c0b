"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. Items go in order of decreasing length into the open bin
with the least room that fits. If none fits, a bin of the least-cost size is opened: the size whose
cost for each token that can still be placed in it is lowest, among those that may be opened and hold
the item. At last each bin is downsized to the smallest permitted size that holds its contents.

The sizes are weighed jointly: all items are packed once for each set of sizes that may be opened
(every set that has the smallest size that holds the longest item, or a larger one), and the packing
of the lowest total cost after downsizing stays.

Items are dealt by hash into shards of a bounded number of tokens, each packed on its own; a shard
leaves at most a few bins part full, so the loss does not grow with the data. Documents longer than
the largest size are cut into pieces of that size and a rest. A bin's row has its token ids and the
places of its documents.

Defined cases: a null or empty text has the end token alone; rows are dealt by doc_id, text and place
in their partition, a null doc_id like any; repeated rows are items of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back, parts
from .byte_bpe import library_memo
from .shared import table, texts
from .units import id_lists, ids_of_lists, with_end

SIZES = (512, 1024, 2048, 4096, 8192)
END_ID = 0
#: Cost of a bin of size c: a fixed part, its tokens, and attention's square.
FIXED_COST, SQUARE_COST = 128.0, 1 / 65536
BYTES_A_SHARD = 4 << 20  # of text; a token has one byte at least


def cost(size: int) -> float:
    return FIXED_COST + size + SQUARE_COST * size * size


def pack_items(lengths: list[int], sizes: tuple[int, ...], opened: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, which come in decreasing length, and the bins' final sizes;
    bins of the sizes `opened` are opened."""
    left = sum(lengths)
    room_of: dict[int, list[int]] = {}  # room -> bins that have it
    rooms = 0  # bit r: a bin has room r
    bins, offsets, filled = [], [], []
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = room_of[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room = min((s for s in opened if s >= n), key=lambda s: (cost(s) / max(1, min(s, left)), s))
            b = len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        left -= n
        room -= n
        room_of.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins, offsets, [next(s for s in sizes if s >= f) for f in filled]


def pack_jointly(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """As `pack_items`, over the set of opened sizes whose packing costs least; among equals the smaller set."""
    longest = lengths[0] if lengths else 0
    sets = [c for k in range(1, len(sizes) + 1) for c in combinations(sizes, k) if c[-1] >= longest]
    return min((pack_items(lengths, sizes, c) for c in sets), key=lambda packed: sum(map(cost, packed[2])))


def token_pieces(docs: DataFrame, vocab_path: str, most: int, end_id: int = END_ID) -> DataFrame:
    """doc_id, deal (a hash of the row and one of 64 salts), piece_start, ids of pieces of at most `most`
    tokens; each document ends with end_id."""
    d = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("deal"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = library_memo(vocab_path), 0
        for b in batches:
            row = 0
            for flat, sizes in memo.slices(b.column(1)):
                flat, sizes = with_end(flat, sizes, end_id)
                fan = -(-sizes // most)
                doc = np.repeat(np.arange(len(sizes)), fan)
                start = most * (np.arange(len(doc)) - np.repeat(np.cumsum(fan) - fan, fan))
                place = pa.array(row + doc)
                deal = b.column(2).to_numpy()[row + doc] ^ ((seen + row + doc) % 64)  # repeated rows differ
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(place), pa.array(deal), pa.array(start), id_lists(flat, np.minimum(most, sizes[doc] - start))],
                    names=["doc_id", "deal", "piece_start", "ids"],
                )
                row += len(sizes)
            seen += row

    return d.mapInArrow(run, f"doc_id {kind}, deal bigint, piece_start bigint, ids array<int>")


def pack(pieces: DataFrame, shards: int, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row for each bin: bin_id, bin_size, n_tokens, ids, and of its pieces in order doc_ids,
    piece_starts, n_piece_tokens (they lie one after another from the bin's first token)."""
    sizes = tuple(sorted(sizes))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    each = pieces.withColumn("shard", F.pmod(F.xxhash64("deal", "piece_start"), F.lit(shards)))

    def run(group: pa.Table) -> pa.Table:
        if library_memo.cache_info().currsize:  # all items are encoded: a worker that encoded before needs its memo no more
            library_memo.cache_clear()
            give_back()
        g = group.combine_chunks()
        flat, n = ids_of_lists(g.column("ids").combine_chunks())
        key = pa.table({"n": n, "doc_id": g.column("doc_id"), "start": g.column("piece_start"), "deal": g.column("deal")})
        order = pa.compute.sort_indices(key, [("n", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")]).to_numpy()
        bins, _, final = pack_jointly(n[order].tolist(), sizes)
        bins = np.array(bins, np.int64)
        turn = np.argsort(bins, kind="stable")
        order, bins = order[turn], bins[turn]  # pieces bin by bin
        first = np.cumsum(n) - n
        size = n[order]
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat((first[order] - (np.cumsum(size) - size)).astype(np.int32), size)
        fan = np.bincount(bins, minlength=len(final))
        ends = np.concatenate([[0], np.cumsum(fan)]).astype(np.int32)
        held = np.add.reduceat(size, ends[:-1])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), x)
        return pa.table({
            "bin_id": (int(g.column("shard")[0].as_py()) << 32) + np.arange(len(final), dtype=np.int64),
            "bin_size": np.array(final, np.int64), "n_tokens": held,
            "doc_ids": lists(g.column("doc_id").combine_chunks().take(pa.array(order))),
            "piece_starts": lists(g.column("piece_start").combine_chunks().take(pa.array(order))),
            "n_piece_tokens": lists(pa.array(size)), "ids": id_lists(flat[at], held),
        })

    return each.groupBy("shard").applyInArrow(
        run,
        f"bin_id bigint, bin_size bigint, n_tokens bigint, doc_ids array<{kind}>, piece_starts array<bigint>, n_piece_tokens array<bigint>, ids array<int>",
    )


def pack_documents(docs: DataFrame, vocab_path: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    size = texts(docs).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return pack(token_pieces(docs, vocab_path, max(sizes)), parts(size, BYTES_A_SHARD), sizes)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram over words and an end mark. Level one of the trie holds the
contexts (64-bit word hashes), level two the successors of each context (40 bits of their hash,
made monotone by the context's number), both Elias-Fano coded with monotone pointers between them,
and a quantised log10 of the smoothed probability for each successor. Levels are memory-mapped; a
query finds its context, then searches the successor inside that context's range.

A trie is sharded by ranges of the context's hash. Contexts with a large share of all tokens are
split over several shards by the successor's hash: a block knows the counts of its own words from the
unigrams, so every block deals a context alike and no list of hot ones is gathered. Documents are
gathered into blocks; a block asks a shard once for each distinct bigram, and training counts travel
with the questions. A message holds one bigram at least, so there are never more messages than distinct
bigrams of the blocks.

Two successors of one context share a code where 40 bits of their hashes agree: of n successors of a
context about n * n / 2 ** 41 pairs, none among a million and 4,500 of a hundred million.

    P(w | v) = (c(v, w) + mu * P(w)) / (c(v) + mu),   P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Defined cases: a null or wordless text has the end mark alone; a null doc_id counts as training;
repeated rows count again; without training tokens V and N are zero; an empty table gives an empty
result; other columns are ignored. doc_ids are integers.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import gathered, pack, pack_sorted, parts, shard_of, slices, unpack, unpack_sorted
from .elias_fano import EliasFano
from .shared import materialize, table, texts

#: No word has white space, so this is no word's hash input.
END = xxhash.xxh64_intdigest(b" ")
MU = 200.0
#: A stored code q stands for the probability 10 ** (-q / STEPS); 0 is kept for "not in the trie".
STEPS = 2048
WORDS_A_SHARD, BIGRAMS_A_SHARD = 1_500_000, 2_000_000
_SUCCESSOR_BITS = 40


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def is_held_out(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def token_blocks(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """Blocks of token numbers; a word's number is its place among the block's sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, bodies in gathered(batches):
            number = _Numbers()
            get, each = number.__getitem__, []
            for body in bodies:
                w = body.lower().split()
                each.append(np.fromiter(map(get, w), np.int64, len(w)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            words, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
            sizes = np.fromiter(map(len, each), np.int64, len(each)) + 1
            tokens = np.full(sizes.sum(), place[-1])
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(sizes) - 1] = False
            tokens[inner] = place[np.concatenate(each)]
            held = np.array([is_held_out(i, folds, fold) for i in ids], np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(held)]), pa.array([pack(sizes)]),
                    pa.array([pack(tokens.astype(np.uint32))]), pa.array([pack_sorted(words)]),
                    pa.array([len(words)]), pa.array([len(tokens)]), pa.array([int(sizes[held == 0].sum())]),
                ],
                names=["block", "doc_ids", "held", "sizes", "tokens", "words", "n_words", "n_tokens", "n_train"],
            )

    d = texts(docs).select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(
        run,
        "block bigint, doc_ids array<bigint>, held binary, sizes binary, tokens binary, words binary, n_words bigint, n_tokens bigint, n_train bigint",
    )


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens, training weight of each, sizes, words of a block."""
    tokens, sizes = unpack(row["tokens"], np.uint32).astype(np.int64), unpack(row["sizes"], np.int64)
    return tokens, np.repeat(unpack(row["held"], np.uint8) == 0, sizes), sizes, unpack_sorted(row["words"])


def unigrams(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, counts of the block's words in the shard; one row of each shard also has the
    number of distinct training words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, train, _, words = _arrays(row)
                counts = np.bincount(tokens[train], minlength=len(words)).astype(np.uint32)
                rows = [(s, row["block"], pack_sorted(words[i:j]), pack(counts[i:j])) for s, i, j in slices(shard_of(words, shards))]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "block", "words", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        words = [unpack_sorted(r["words"]) for r in rows]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"], np.uint32) for r in rows]), len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        n = len(rows) - 1
        return pa.table({
            "shard": group.column("shard"), "block": group.column("block"),
            "answer": pa.array([pack(total[place[e - len(w) : e]]) for w, e in zip(words, ends)], pa.binary()),
            "distinct": pa.array([int((total > 0).sum())] + [None] * n, pa.int64()),
        })

    asked = blocks.mapInArrow(ask, "shard bigint, block bigint, words binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "shard bigint, block bigint, answer binary, distinct bigint")


def own_counts(got: list[dict]) -> np.ndarray:
    """Training counts of a block's words from the unigrams' answers."""
    rows = sorted((r["shard"], r["answer"]) for r in got)
    return np.concatenate([unpack(x, np.uint64) for _, x in rows] + [np.zeros(0, np.uint64)])


class Dealer:
    """The shard of a bigram: by its context, frequent contexts over several shards by the successor."""

    def __init__(self, shards: int, hot_from: int):
        self.shards, self.hot_from = shards, np.uint64(max(1, hot_from))

    def is_hot(self, count: np.ndarray) -> np.ndarray:
        return count >= self.hot_from

    def shard(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> np.ndarray:
        """count: the context's."""
        spread = np.minimum(np.uint64(1) + count // self.hot_from, np.uint64(self.shards))
        away = ((successor >> np.uint64(32)) * spread) >> np.uint64(32)
        return (shard_of(context, self.shards) + np.where(self.is_hot(count), away, 0).astype(np.int64)) % self.shards


def block_bigrams(tokens: np.ndarray, words: np.ndarray, counts: np.ndarray, dealer: Dealer):
    """Distinct bigrams of a block in the order in which shards are asked: context and successor
    (numbers), shard, and the place of each token's bigram."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]  # a document begins after the end mark of the one before
    before[:1] = np.searchsorted(words, np.uint64(END))
    code, place = np.unique(before * len(words) + tokens, return_inverse=True)
    a, b = np.divmod(code, len(words))
    shard = dealer.shard(words[a], words[b], counts[a])
    order = np.argsort(shard, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return a[order], b[order], shard[order], back[place]


class BigramTrie:
    """One shard's levels in a memory-mapped file."""

    def __init__(self, path: str, contexts: np.ndarray, number: np.ndarray, successor: np.ndarray, code: np.ndarray):
        """contexts ascending; number (of the context) and successor ascending together."""
        keys = (number.astype(np.uint64) << np.uint64(_SUCCESSOR_BITS)) | successor
        first = np.searchsorted(number, np.arange(len(contexts) + 1)).astype(np.uint64)
        self.path, self.meta = path, []
        with open(path, "wb") as f:
            for values, universe in ((contexts, 1 << 64), (first, len(keys) + 1), (keys, max(1, len(contexts)) << _SUCCESSOR_BITS)):
                n, width, low, high = EliasFano.arrays(values, universe)
                self.meta.append((n, width, self._put(f, low), self._put(f, high)))
            self.code = self._put(f, code)

    @staticmethod
    def _put(f, values: np.ndarray) -> tuple[int, str, int]:
        f.write(bytes(-f.tell() % 8))
        at = f.tell()
        f.write(values.tobytes())
        return at, values.dtype.str, len(values)

    def _map(self, at: tuple[int, str, int]) -> np.ndarray:
        return np.memmap(self.path, at[1], "r", at[0], (at[2],)) if at[2] else np.zeros(0, at[1])

    def open(self) -> BigramTrie:
        self.contexts, self.pointers, self.keys = (EliasFano(n, w, self._map(a), self._map(b)) for n, w, a, b in self.meta)
        self.codes = self._map(self.code)
        return self

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes, 0 where the trie lacks the bigram. context: ascending distinct hashes repeated as
        wanted; successor: their low-level keys."""
        out = np.zeros(len(context), np.uint16)
        if not self.keys.n:
            return out
        asked, back = np.unique(context, return_inverse=True)
        at = self.contexts.successor(asked)
        there = at < self.contexts.n
        there[there] = self.contexts.access(at[there]) == asked[there]
        at = np.where(there, at, 0)
        first, last = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        key = (at[back].astype(np.uint64) << np.uint64(_SUCCESSOR_BITS)) | successor
        rows = np.flatnonzero(there[back])
        key, first, last = key[rows], first[back[rows]], last[back[rows]]
        found = self.keys.successor(key, first, last)
        hit = found < last
        hit[hit] = self.keys.access(found[hit]) == key[hit]
        out[rows[hit]] = self.codes[found[hit]]
        return out


def bigrams(blocks: DataFrame, single: DataFrame, dealer: Dealer, mu: float) -> DataFrame:
    """shard, block, answer: the trie's code for each bigram that a block asked a shard for."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names, rows = ("shard", "block", "contexts", "fan", "totals", "successors", "counts"), []
        for row in left.to_pylist():
            tokens, train, _, words = _arrays(row)
            known = own_counts(right.to_pylist())
            a, b, shard, place = block_bigrams(tokens, words, known, dealer)
            counts = np.bincount(place[train], minlength=len(a)).astype(np.uint32)
            successor, total = words[b] >> np.uint64(64 - _SUCCESSOR_BITS), np.where(dealer.is_hot(known), known, 0).astype(np.uint64)
            for s, i, j in slices(shard):
                begin = np.flatnonzero(np.diff(a[i:j], prepend=-1))
                fan, some = np.diff(begin, append=j - i).astype(np.uint32), a[i:j][begin]
                rows.append((s, row["block"], pack_sorted(words[some]), pack(fan), pack(total[some]), pack(successor[i:j]), pack(counts[i:j])))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        context = [np.repeat(unpack_sorted(r["contexts"]), unpack(r["fan"], np.uint32)) for r in rows]
        successor = [unpack(r["successors"], np.uint64) for r in rows]
        counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
        seen = counts > 0
        given = np.concatenate([np.repeat(unpack(r["totals"], np.uint64), unpack(r["fan"], np.uint32)) for r in rows])[seen]
        known, number = np.unique(np.concatenate(context)[seen], return_inverse=True)
        stated = np.zeros(len(known))  # a frequent context's successors are spread; its count came along
        stated[number] = given
        del given
        keys, place = np.unique((number.astype(np.uint64) << np.uint64(_SUCCESSOR_BITS)) | np.concatenate(successor)[seen], return_inverse=True)
        count = np.bincount(place, counts[seen], len(keys))
        number = (keys >> np.uint64(_SUCCESSOR_BITS)).astype(np.int64)
        total = np.bincount(number, count, len(known))
        total = np.where(stated > 0, stated, total)
        p = count / (total[number] + mu)
        code = np.clip(np.ceil(-np.log10(p) * STEPS), 1, 65535).astype(np.uint16)  # rounded down: no mass is added
        out = []
        with tempfile.TemporaryDirectory() as folder:
            trie = BigramTrie(os.path.join(folder, "levels"), known, number, keys & np.uint64((1 << _SUCCESSOR_BITS) - 1), code)
            del keys, place, count, p, code, number, counts
            trie.open()
            for c, s in zip(context, successor):
                out.append(pack(trie.lookup(c, s)))
            del trie
        return pa.table({"shard": group.column("shard"), "block": group.column("block"), "answer": pa.array(out, pa.binary())})

    asked = blocks.groupBy("block").cogroup(single.groupBy("block")).applyInArrow(
        ask, "shard bigint, block bigint, contexts binary, fan binary, totals binary, successors binary, counts binary"
    )
    return asked.groupBy("shard").applyInArrow(answer, "shard bigint, block bigint, answer binary")


def score(docs: DataFrame, mu: float = MU, folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; those
    whose crc32 of the id's text leaves `fold` by `folds` are not learnt from."""
    blocks = token_blocks(docs, folds, fold)
    blocks = materialize(blocks, "token-blocks")
    n_words, n_tokens, n_train = [x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first()]
    shards = parts(n_tokens, BIGRAMS_A_SHARD)
    single = materialize(unigrams(blocks, parts(n_words, WORDS_A_SHARD)), "unigram-answers")
    distinct = single.agg(F.sum("distinct")).first()[0] or 0
    dealer = Dealer(shards, n_train // (2 * shards) if shards > 1 else n_train + 1)
    left = blocks.select("block", "doc_ids", "held", "sizes", "tokens", "words")  # shuffled by block once for both uses
    one = single.select("block", F.lit(1).alias("n"), "shard", "answer")
    double = bigrams(left, one, dealer, mu)
    answers = one.union(double.select("block", F.lit(2).alias("n"), "shard", "answer"))
    norm = np.log10(n_train + 0.5 * (distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        tokens, train, sizes, words = _arrays(row)
        got = right.to_pylist()
        count = own_counts([r for r in got if r["n"] == 1])
        code = np.concatenate([unpack(x, np.uint16) for _, x in sorted((r["shard"], r["answer"]) for r in got if r["n"] == 2)])
        a, b, _, place = block_bigrams(tokens, words, count, dealer)
        count = count.astype(float)
        base = np.log10(count + 0.5) - norm
        alpha = np.where(code > 0, 10.0 ** (code / -STEPS), 0.0)
        both = np.log10(alpha + mu / (count[a] + mu) * 10.0 ** base[b])
        starts = np.cumsum(sizes) - sizes
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(unpack(row["held"], np.uint8) == 1),
            "n_tokens": sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64)[tokens], starts),
            "train_tokens": np.full(len(sizes), n_train, np.int64),
            "base_score": np.add.reduceat(base[tokens], starts), "score": np.add.reduceat(both[place], starts),
        })

    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def op1_ngram_trie(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

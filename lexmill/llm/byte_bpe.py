"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece's adjacent pairs are the leaves; a leaf holds its pair's rank and place, so the root is the
leftmost pair of the lowest rank. A merge changes three leaves, each updated up to the root in
logarithmic time, until the root says that no pair can merge. Short pieces are processed as rows of
one numpy table, long ones alone.

Texts are first cut into units (see units.py), whose ids a bounded memo per Python worker keeps. A
unit of ASCII characters is cut into pieces by the vocabulary's pattern; others by the tokenizers
library's own pre-tokenizer, which knows the same Unicode tables as the encoder it is held against.

Defined cases: a null text is empty and has no ids; the strings of added tokens in a text become
their ids, as in the library's default; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import table, texts
from .units import PLAIN_WORD, Memo, id_lists, ids_of_lists, split_ids

#: The vocabulary's pattern for ASCII text.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BIG = np.int64(1) << 62
_ALONE = 256  # longer pieces are processed alone
_TOGETHER = 200  # words in one text for the library


class SegmentTreeBpe:
    """Merges of one vocabulary file (byte-level BPE of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        shown = _byte_alphabet()
        back = {c: b for b, c in enumerate(shown)}
        self.n = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * self.n
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.of_byte = np.array([vocab[c] for c in shown], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it cannot merge or a side is missing (-1)."""
        want = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 4
        while width <= _ALONE:
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 4 else 0)))
            for at in range(0, len(rows), max(1, (1 << 18) // width)):
                some = rows[at : at + max(1, (1 << 18) // width)]
                for i, ids in zip(some, self._table([pieces[i] for i in some], size[some], width)):
                    out[i] = ids
            width *= 2
        for i in np.flatnonzero(size > _ALONE):
            out[i] = self._alone(pieces[i])
        return out

    def _table(self, pieces: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        places = np.arange(width)
        tok = np.where(places < size[:, None], self.of_byte[raw], -1)
        nxt = np.tile(np.where(places + 1 < width, places + 1, -1), (n, 1))
        prv = np.tile(places - 1, (n, 1))
        tree = np.full((n, 2 * width), _BIG, np.int64)
        rank = self.pair_ranks(tok[:, :-1], tok[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(rank >= 0, rank * width + places[:-1], _BIG)
        for level in _levels(width):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < _BIG)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            before = prv[rows, at]
            tok[rows, at] = self.into[rank]
            tok[rows, gone] = -1
            nxt[rows, at] = after
            has = after >= 0
            prv[rows[has], after[has]] = at[has]
            self._set(tree, width, rows, gone, np.full(len(rows), _BIG))
            ranks = self.pair_ranks(tok[rows, at], np.where(has, tok[rows, after], -1))
            self._set(tree, width, rows, at, np.where(ranks >= 0, ranks * width + at, _BIG))
            left = before >= 0
            r, b, a = rows[left], before[left], at[left]
            ranks = self.pair_ranks(tok[r, b], tok[r, a])
            self._set(tree, width, r, b, np.where(ranks >= 0, ranks * width + b, _BIG))
            rows = rows[tree[rows, 1] < _BIG]
        stay = tok >= 0
        flat, ends = tok[stay].astype("<u4").tobytes(), np.cumsum(stay.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def _set(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """A point update in each of the rows' trees."""
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _alone(self, piece: bytes) -> bytes:
        """One long piece: the same tree in plain lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        first = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(first[:-1], first[1:])
        level = np.full(width, _BIG, np.int64)
        level[: n - 1] = np.where(ranks >= 0, ranks * width + np.arange(n - 1), _BIG)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [int(_BIG)] + [int(v) for x in reversed(levels) for v in x]
        tok, nxt, prv, big = first.tolist(), [*range(1, n), -1], [*range(-1, n - 1)], int(_BIG)
        rank_of = _pair_table(self)

        def put(leaf: int, a: int, b: int) -> None:
            r = rank_of.get((a, b)) if a >= 0 and b >= 0 else None
            node = leaf + width
            tree[node] = big if r is None else r * width + leaf
            while node > 1:
                node >>= 1
                x, y = tree[2 * node], tree[2 * node + 1]
                tree[node] = x if x < y else y

        while tree[1] < big:
            rank, at = divmod(tree[1], width)
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            tok[at], tok[gone], nxt[at] = int(self.into[rank]), -1, after
            if after >= 0:
                prv[after] = at
            put(gone, -1, -1)
            put(at, tok[at], tok[after] if after >= 0 else -1)
            if before >= 0:
                put(before, tok[before], tok[at])
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        place: dict[bytes, int] = {}
        cuts = []
        for u in units:
            parts = [u] if PLAIN_WORD(u) else _ASCII.findall(u) if u.isascii() else _library_cuts(u.decode())
            cuts.append([place.setdefault(p, len(place)) for p in parts])
        ids = self.encode_pieces(list(place))
        return [b"".join(map(ids.__getitem__, c)) for c in cuts]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _levels(width: int) -> Iterator[int]:
    while width > 1:
        width //= 2
        yield width


@lru_cache(maxsize=2)
def _pair_table(bpe: SegmentTreeBpe) -> dict[tuple[int, int], int]:
    a, b = np.divmod(bpe.keys, bpe.n)
    return dict(zip(zip(a.tolist(), b.tolist()), bpe.rank.tolist()))


@lru_cache(maxsize=1)
def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones of Latin-1 for
    themselves, the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def _library_cuts(unit: str) -> list[bytes]:
    return [unit[a:b].encode() for _, (a, b) in _splitter().pre_tokenize_str(unit)]


@lru_cache(maxsize=2)
def segment_tree_memo(path: str) -> tuple[SegmentTreeBpe, Memo]:
    """Once for each Python worker."""
    bpe = SegmentTreeBpe(path)
    return bpe, Memo(bpe.encode_units, bpe.added)


@lru_cache(maxsize=2)
def library_memo(path: str) -> Memo:
    """The same memo over the tokenizers library's encoder, once for each Python worker."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    space = _byte_alphabet()[32]
    opens = np.array([(tok.id_to_token(i) or "").startswith(space) for i in range(tok.get_vocab_size())])

    def library(texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(units: list[bytes]) -> list[bytes]:
        """Plain words go to the library many in one text: a word's first token, and no other, begins with a space."""
        words, other = [], []
        for u in units:
            (words if PLAIN_WORD(u) else other).append(u)
        known = dict(zip(other, (x.tobytes() for x in library(other))))
        groups = [words[at : at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        for some, ids in zip(groups, library([b"".join(g) for g in groups])):
            starts = 4 * np.flatnonzero(opens[ids])
            flat, ends = ids.tobytes(), [*starts[1:].tolist(), 4 * len(ids)]
            known.update(zip(some, (flat[a:b] for a, b in zip(starts.tolist(), ends)), strict=True))
        return [known[u] for u in units]

    return Memo(encode, added)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids array<int>."""
    d = texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = segment_tree_memo(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), id_lists(*memo.encode(b.column(1)))], names=["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids array<int>; null ids are none."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = segment_tree_memo(vocab_path)
        for b in batches:
            out = [bpe.decode(x) for x in split_ids(*ids_of_lists(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op8_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that these ids decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    d = texts(table(spark, sf_dir, "documents"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = segment_tree_memo(path)
        sha = hashlib.sha256
        for b in batches:
            sizes, hashes, decoded = [], [], []
            for flat, n in memo.slices(b.column(1)):
                for x in split_ids(flat, n):
                    hashes.append(sha(x).hexdigest())
                    decoded.append(sha(bpe.decode(x).encode()).hexdigest())
                sizes += n.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return d.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

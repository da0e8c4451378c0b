import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash

from lexmill.llm import backward_search, blocks, elias_fano, ngram_trie, registry, simhash_mih, suffix_dedup

from .conftest import pairs


def test_elias_fano_successor_and_access():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1 << 63), (50, 60), (1000, 1 << 40), (5000, 1 << 62)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        e = elias_fano.EliasFano(*elias_fano.EliasFano.arrays(v, 1 << 64 if top > 1 << 60 else top))
        assert (e.access(np.arange(len(v))) == v).all()
        x = np.concatenate([v, rng.integers(0, top, 500).astype(np.uint64)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()


def test_pack_round_trips():
    for v in (np.zeros(0, np.uint64), np.arange(1000, dtype=np.uint64) ** 3):
        assert (blocks.unpack_sorted(blocks.pack_sorted(v)) == v).all()
    assert (blocks.unpack(blocks.pack(np.arange(7, dtype=np.int64) - 3), np.int64) == np.arange(7) - 3).all()


def ngram_truth(docs, mu):
    words = {k: [*t.encode().lower().split(), b" "] for k, (_, t) in enumerate(docs)}
    one, two = collections.Counter(), collections.Counter()
    for k, (i, _) in enumerate(docs):
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(words[k])
            two.update(zip([b" ", *words[k]], words[k]))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    for k, (i, _) in enumerate(docs):
        w = words[k]
        yield (
            i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w),
            sum(math.log10((two[a, x] + mu * p(x)) / (one[a] + mu)) for a, x in zip([b" ", *w], w)),
        )


@pytest.mark.parametrize("sharded", [False, True])
@pytest.mark.parametrize("which", ["odd", "small"])
def test_ngram_scores(request, monkeypatch, which, sharded):
    docs = request.getfixturevalue(which)
    if sharded:  # hot contexts are split over shards
        monkeypatch.setattr(ngram_trie, "BIGRAMS_A_SHARD", 3000)
        monkeypatch.setattr(ngram_trie, "WORDS_A_SHARD", 1000)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in ngram_trie.score(docs).collect()), key=key)
    want = sorted(ngram_truth(pairs(docs), ngram_trie.MU), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=1e-3 * w[2])  # quantised probabilities


def test_model_beats_words_alone_on_held_out_texts(spark):
    held = ngram_trie.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    r = held.selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r["s"] > 0.95 * r["b"]


def removal_truth(docs, length):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t in docs:
        b = t.encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(key(i), first.get(b[p : p + length], math.inf))
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        yield i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [20000, 2])
@pytest.mark.parametrize("which", ["odd", "small"])
def test_removed_bytes(request, monkeypatch, which, hot):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(suffix_dedup, "SEGMENTS_A_SHARD", 150)
    monkeypatch.setattr(suffix_dedup, "KEYS_A_SHARD", 4000)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in suffix_dedup.measure(docs, hot=hot).collect()), key=key)
    assert got == sorted(removal_truth(pairs(docs), 50), key=key)


def test_removal_keeps_rows_columns_and_characters(odd):
    out = {(r["doc_id"], r["text"]): r for r in suffix_dedup.remove(odd).collect()}
    assert odd.columns == suffix_dedup.remove(odd).columns and suffix_dedup.remove(odd).count() == odd.count()
    texts = {k[0]: k[1] for k in out if k[0] is not None}
    assert texts[2] == "" and texts[4] is None and texts[5] == "" and len(texts[13]) < 4
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.values())


def test_suffix_order_and_owners():
    rng = np.random.default_rng(3)
    for _ in range(60):
        t = rng.integers(97, 99, rng.integers(1, 200)).astype(np.uint8)
        t = np.append(t, np.uint8(255))
        assert backward_search.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: bytes(t[i:]))
        length = 9
        ends = np.arange(length, len(t))
        owner = rng.permutation(len(ends))
        strings = [bytes(t[e - length : e]) for e in ends]
        want = [min(o for s, o in zip(strings, owner) if s == x) for x in strings]
        assert backward_search.smallest_owner(t, ends, owner, length).tolist() == want


def fingerprint_truth(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("which", ["odd", "small"])
def test_simhash_groups(request, which):
    docs = request.getfixturevalue(which)
    rows = pairs(docs)
    fps = {t: fingerprint_truth(t) for _, t in rows}
    parent = {f: f for f in fps.values()}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(set(fps.values()), 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = collections.defaultdict(lambda: None)
    for i, t in rows:
        r = root(fps[t])
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    want = sorted(((i, fps[t], least[root(fps[t])]) for i, t in rows), key=str)
    got = sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash_mih.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_simhash_links_with_more_segments(spark):
    fps = [0, 7, 15, 1 << 40, (1 << 40) | 7, (1 << 63) - 1, -1, 5 << 31]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for segments in (2, 3, 4):
        assert {tuple(r) for r in simhash_mih.links(nodes, 3, segments).collect()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash_mih.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_first_of_each_group_stays(odd):
    kept = [r["doc_id"] for r in simhash_mih.keep_first(odd).collect()]
    assert kept.count(1) == 2 and 2 not in kept and kept.count(None) == 2 and 9 in kept and 11 in kept


@pytest.mark.parametrize("f", [ngram_trie.score, suffix_dedup.measure, suffix_dedup.remove, simhash_mih.near_duplicates])
def test_empty_tables(empty, f):
    assert f(empty).collect() == []


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 14))

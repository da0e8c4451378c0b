import itertools
import random
from collections import Counter

import corpus_pipeline as cp
from lexmill.llm import shingle_copies

from .conftest import SCHEMA, SF, pairs


def shingle_sets(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_brute_force(rows):
    """The smallest id of each component of pairs at 0.8 or more."""
    s, root = {i: shingle_sets(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in itertools.combinations(s, 2):
        if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_pipeline_stage_drops_near_copies(spark, small):
    stage = dict(cp.STAGES)["simhash near-dedup"]
    got = sorted(r["doc_id"] for r in stage(spark, small, SF).collect())
    assert got == kept_by_brute_force(pairs(small)) and 177 not in got and 145 not in got


def test_copies_with_edits(spark):
    rng, rows = random.Random(8), []
    for g in range(30):
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        for k in range(4):
            w = list(base)
            for p in rng.sample(range(200), 2 * k):  # at 6 edits pairs lie on both sides of 0.8
                w[p] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[None] * 13) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in shingle_copies.keep_first(docs).collect()) == kept_by_brute_force(rows)


def test_large_groups_and_their_members(spark):
    rng, rows = random.Random(3), []
    for _ in range(3):
        base = [f"w{rng.randrange(2000)}" for _ in range(150)]
        for _ in range(30):  # without the base itself: pairs on both sides of 0.8
            w = list(base)
            for p in rng.sample(range(150), rng.randrange(1, 7)):
                w[p] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[None] * 13) for i, t in rows], SCHEMA)
    kept = kept_by_brute_force(rows)
    assert sorted(r["doc_id"] for r in shingle_copies.keep_first(docs).collect()) == kept
    each, groups = shingle_copies.members(docs)
    links = {r["doc_id"]: r["kept_id"] for r in each.join(groups, "node").collect()}
    assert links.keys() == {i for i, _ in rows} and sorted(set(links.values())) == kept


def test_simhash_balls(spark):
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randrange(2000)}" for _ in range(400)]
        for k in range(3):  # without, with one and with two edits: 0 to some bits apart
            w = list(base)
            for p in rng.sample(range(400), k):
                w[p] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[None] * 13) for i, t in rows], SCHEMA)
    each = shingle_copies._fingerprints(docs)
    fps = {r["doc_id"]: r["fp"] for r in each.collect()}
    for i, t in rows:
        s = [int(x) for x in shingle_copies.shingles(t)]
        assert fps[i] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s))
    root = {f: f for f in fps.values()}
    for a, b in itertools.combinations(set(root), 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 3 and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {f: lo if r == hi else r for f, r in root.items()}
    sizes = Counter(root.values())
    got = {r["fp"]: r["ball"] for r in shingle_copies.balls(each).collect()}
    assert got and got == {f: r for f, r in root.items() if sizes[r] > 1}


def test_empty(empty):
    assert shingle_copies.keep_first(empty).collect() == []


def test_rows_not_ids_are_dropped(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, "n " * 30), (None, "n " * 30)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t), *[None] * 13) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in shingle_copies.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (7, c), (None, "n " * 30)], key=str)

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lexmill.llm import line_dedup
from lexmill.llm.cuckoo import Cuckoo, Filters
from lexmill.llm.shared import fresh_dir


def key(line):
    return "".join(c.lower() if c < "\x80" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_force(indexed, asked):
    held = defaultdict(set)
    for i, t in indexed:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in asked:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < 3 or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def measured(index, docs, **k):
    return sorted(map(tuple, index.measure(docs, **k).collect()), key=str)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    common = [f"  Common line number {k} é with some words" for k in range(25)] + ["short", "", "ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ 1", "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(common).upper() if rng.random() < 0.2 else rng.choice(common) + rng.choice(["", " \t"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(3, "Common line number 1 é with some words"), (None, rows[5][1]), (None, None), (70, None), (71, "")]
    rows += [(i, "a line that every one of them holds, twice\n" * 2) for i in range(80, 140)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "k", 1) for i, t in rows], "doc_id long, text string, n_chars int, keys string, hi int")


def test_equals_brute_force(spark, lines, odd, empty):
    docs = frame(spark, lines)
    index = line_dedup.build(docs)
    want = brute_force(lines, lines)
    assert measured(index, docs) == want and measured(index, docs, most=0) == want
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert measured(line_dedup.build(odd), odd) == brute_force(rows, rows)
    assert measured(line_dedup.build(empty), empty) == []


def test_insertions_and_deletions_are_reversible(spark, lines):
    docs = frame(spark, lines)
    path = fresh_dir(spark, "line-index")
    index = line_dedup.LineIndex.create(spark, path, 5)
    parts = [[r for r in lines if (r[0] or 0) % 3 == k] for k in range(3)]
    seen = []
    for p in parts:
        index.insert(frame(spark, p))
        seen += p
        assert measured(index, docs) == brute_force(seen, lines)
    before = measured(index, docs)
    index.insert(frame(spark, parts[1]))  # again: nothing changes
    assert measured(index, docs) == before
    gone = [(i, t) for i, t in lines if i is not None and i % 2]
    index.delete(spark.createDataFrame([(i,) for i, _ in gone] + [(None,), (9999,)], "doc_id long"))
    stay = [r for r in lines if r not in gone]
    assert measured(index, docs) == brute_force(stay, lines)
    again = line_dedup.LineIndex(spark, path)
    assert again.version == index.version and measured(again, docs, most=0) == brute_force(stay, lines)
    again.insert(frame(spark, gone))
    assert measured(again, docs) == before
    again.delete(docs.select("doc_id"))
    assert {r[2] for r in measured(again, docs)} == {0} and again.counts().where("refs > 0").isEmpty()


def test_a_lost_run_leaves_the_old_version(spark, lines):
    index = line_dedup.build(frame(spark, lines[:30]))
    want = measured(index, frame(spark, lines))
    index._write(line_dedup.doc_keys(frame(spark, lines[30:])), "lines")  # a run that died before its commit
    opened = line_dedup.LineIndex(spark, index.path)
    assert measured(opened, frame(spark, lines)) == want
    assert measured(opened.insert(frame(spark, lines[30:])), frame(spark, lines)) == brute_force(lines, lines)


def test_dedup_keeps_rows_and_columns(spark, lines, odd):
    docs = frame(spark, lines)
    got = line_dedup.build(docs).dedup(docs)
    assert got.schema == docs.schema
    rows = got.collect()
    texts = [(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    assert sorted(texts, key=str) == sorted([(r[0], r[3]) for r in brute_force(lines, lines)], key=str)
    assert all(r[2] == (None if r[1] is None else len(r[1])) and tuple(r[3:]) == ("k", 1) for r in rows)
    assert line_dedup.build(odd).dedup(odd).columns == odd.columns


def test_cuckoo_filters():
    rng = np.random.default_rng(1)
    lo, hi = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    made = Cuckoo.of(lo)
    whole = lambda f: Filters(1, [(0, f.cells.tobytes())]).contain(hi, lo)
    assert whole(made).all()
    made.remove(lo[:2500])
    assert whole(made)[2500:].all() and whole(made)[:2500].mean() < 0.01
    made.insert(lo[:2500])
    assert whole(made).all()
    small = Cuckoo(4)
    small.insert(lo[:100])
    assert small.full
    some = Filters(3, [(1, made.cells.tobytes()), (2, None)])
    assert some.contain(hi, lo)[hi % 3 != 0].all() and not some.contain(hi, lo)[hi % 3 == 0].any()

"""Reach over packed blocks against plain loops, and what it shuffles."""

import random

import pyarrow as pa
import pytest

from lexmill.operators import edge_blocks, graphs
from lexmill.plans import registry


def reached(edges, seeds, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    near.pop(None, None)
    out = set()
    for s in seeds:
        seen = front = {s}
        out.add((s, s, 0))
        for hop in range(1, hops + 1):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen = seen | front
            out |= {(s, x, hop) for x in front}
    return out


def test_reach_keeps_and_shuffles_no_edges(spark, monkeypatch, tmp_path):
    held, settle = {}, graphs.settle

    def counted(df, what):
        out = settle(df, what)
        held.setdefault(what, []).append((out.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(graphs, "settle", counted)
    monkeypatch.setattr(edge_blocks, "EDGES_A_BLOCK", 1000)
    rng = random.Random(5)
    edges = [(rng.randrange(100), rng.randrange(400)) for _ in range(6000)]
    spark.createDataFrame(edges, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(100)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in registry.queries()["g04_reach_three_hops"](spark, str(tmp_path)).collect()]
    want = reached([(a, 10**9 + b) for a, b in edges], range(0, 100, 20), 3)
    assert len(got) == len(want) and set(got) == want
    [(rows, plan)] = held["edges"]
    assert rows == 6
    # edges are dealt into blocks before anything is grouped, so the table's rows are not shuffled
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow ") and "Aggregate" not in plan and "Join" not in plan


def test_blocks_split_a_hub_and_keep_odd_edges(spark, monkeypatch):
    monkeypatch.setattr(edge_blocks, "EDGES_A_BLOCK", 40)
    monkeypatch.setattr(edge_blocks, "LINKS_AT_ONCE", 70)
    rng = random.Random(7)
    big = 2**62
    edges = [(i, 5000) for i in range(300)] * 2 + [(-i, rng.randrange(-30, 30)) for i in range(60)] + [(7, 7), (big, -big), (-big, 3)]
    edges += [(9, None), (None, 9), (None, 5000), (big, None), (None, None), (777, None)]
    rng.shuffle(edges)
    seeds = [0, 3, 7, -5, big, 777, 12345, *range(100, 200)]
    df = spark.createDataFrame(edges, "src long, dst long")
    rows = edge_blocks.blocks(df).collect()
    assert len({r["block"] for r in rows}) == len(rows) and max(r["n"] for r in rows) < 120 < 300
    assert sum(r["n"] for r in rows) == len({e for e in edges if None not in e})
    got = [tuple(r) for r in graphs.reach(df, spark.createDataFrame([(s,) for s in seeds] * 2, "node long"), 3).collect()]
    want = reached(edges, seeds, 3)
    assert len(got) == len(want) and set(got) == want
    assert {d for s, n, d in want if n is None} == {1, 2}


def test_a_hop_takes_its_links_in_turns(monkeypatch):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(40), 100 + rng.randrange(60)) for _ in range(700)})
    block = edge_blocks._merged(pa.Table.from_pylist([edge_blocks._row(4, *edge_blocks._distinct(*map(edge_blocks.np.array, zip(*edges))), edge_blocks.np.array([3, 8]))], schema=edge_blocks._ROW))
    asked = pa.table([pa.array(x, pa.int64()) for x in zip(*[(n, w, rng.randrange(1, 2**62)) for n in range(40) for w in range(3)])], names=["node", "word", "mask"])
    want = {}
    for n, w, m in zip(*(asked[c].to_pylist() for c in asked.column_names)):
        for to in {b for a, b in edges if a == n} | ({None} if n in (3, 8) else set()):
            want[to, w] = want.get((to, w), 0) | m
    for at_once in (10**6, 50):
        monkeypatch.setattr(edge_blocks, "LINKS_AT_ONCE", at_once)
        got = {}
        for r in edge_blocks._carried(asked, block).to_pylist():
            got[r["node"], r["word"]] = got.get((r["node"], r["word"]), 0) | r["got"]
        assert got == want
    assert edge_blocks._carried(asked.slice(0, 0), block).num_rows == edge_blocks._carried(asked, block.slice(0, 0)).num_rows == 0


def test_numbers_have_no_gaps(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = graphs.numbered(spark.createDataFrame([(7 * i % 101,) for i in range(101)] + [(None,)], "k long"), "k")
        got = {r["k"]: r["no"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Spark sorts nulls first; 64 seeds share a word also where they lie in several parts
    assert {k for k, n in got.items() if n < 64} == {None, *range(63)} and sorted(got.values()) == list(range(102))
    assert rows.columns == ["k", "no"]


def test_seeds_that_reach_the_same_share_words(spark, monkeypatch):
    held, settle = [], graphs.settle

    def counted(df, what):
        out = settle(df, what)
        held.append((what, out.count()))
        return out

    monkeypatch.setattr(graphs, "settle", counted)
    monkeypatch.setattr(edge_blocks, "EDGES_A_BLOCK", 500)
    # 8 components, a seed's number says nothing about its component; ids are scattered
    edges = [((37 * (8 * i + c)) % 512, 1000 + (91 * (8 * j + c)) % 320) for c in range(8) for i in range(64) for j in range(40)]
    of = {(37 * k) % 512: k % 8 for k in range(512)}
    packed = settle(edge_blocks.blocks(spark.createDataFrame(edges, "src long, dst long")), "edges")
    kin = edge_blocks.kin(spark.createDataFrame([(n,) for n in [*of, 9999]], "node long"), packed, settle(edge_blocks.places(packed), "places"))
    least = {r["node"]: r["least"] for r in kin.collect()}
    assert least.pop(9999) is None and least == {n: min(m for m in of if of[m] == c) for n, c in of.items()}
    got = [tuple(r) for r in graphs.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in of], "node long"), 3).collect()]
    want = reached(edges, of, 3)
    assert len(got) == len(want) and set(got) == want
    # a word for each component: hop 1 reaches 320 nodes, hop 2 gets back to the 512
    assert [n for what, n in held if what == "front"] == [320, 512, 0]


def test_reach_of_names(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", None), (None, "a"), ("y", "y"), ("", "x")]
    seeds = ["a", "y", "none", ""]
    got = graphs.reach(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in [*seeds, None]], "node string"), 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(reached(edges, seeds, 2) | {(None, None, 0)}, key=str)


def test_empty_and_unfit_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    seeds = spark.createDataFrame([(4,), (None,)], "node int")
    assert {tuple(r) for r in graphs.reach(none, seeds, 2).collect()} == {(4, 4, 0), (None, None, 0)}
    with pytest.raises(TypeError):
        edge_blocks.blocks(spark.createDataFrame([("a", 1)], "src string, dst int"))

"""Queries over whole tables against plain loops."""

import random

from lexmill.plans import registry, retrieval

Q = registry.queries()


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_graph_queries_use_all_edges(spark, tmp_path):
    rng = random.Random(3)
    edges = [(rng.randrange(1, 61), rng.randrange(1, 40)) for _ in range(110)]
    d = written(
        spark, tmp_path, supplier=([(s,) for s in range(1, 61)], "s_suppkey long"),
        lineitem=([(s, p, 1.0, 0.0) for s, p in edges], "l_suppkey long, l_partkey long, l_quantity double, l_discount double"),
    )
    near = {}
    for s, p in edges:
        near.setdefault(s, set()).add(10**9 + p)
        near.setdefault(10**9 + p, set()).add(s)
    want, best = set(), {}
    for seed in (20, 40, 60):
        depth, front = {seed: 0}, {seed}
        for hop in (1, 2, 3):
            front = {b for a in front for b in near.get(a, ())} - set(depth)
            depth |= dict.fromkeys(front, hop)
        want |= {(seed, n, k) for n, k in depth.items()}
        for n, k in depth.items():
            if k < 3:
                best[n] = max(best.get(n, 0), (100.0, 62.0, 26.04)[k])
    assert max(k for _, _, k in want) == 3
    assert {tuple(r) for r in Q["g04_reach_three_hops"](spark, d).select("seed", "node", "depth").collect()} == want
    assert {r["node"]: r["score"] for r in Q["g05_decayed_expansion"](spark, d).collect()} == best


def test_fusion_takes_the_full_lists(spark):
    rows = [(1, i, 200.0 - i, 1) for i in range(50)] + [(1, 100 + i, 100.0 - i, 200 - i) for i in range(50)]
    by = {c: {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[c], r[1])), 1)} for c in (2, 3)}
    fused = lambda last: sorted(
        (-round(sum(w / (60 + by[c][r[1]]) for c, w in ((2, 0.58), (3, 0.42)) if by[c][r[1]] <= last), 9), r[1]) for r in rows
    )[:10]
    got = retrieval._fused_full(spark.createDataFrame(rows, "qid long, id long, bm25 double, matched long")).orderBy("rank").collect()
    assert [(-r["score"], r["id"]) for r in got] == fused(len(rows)) != fused(50)


def test_candidates_reach_600(spark, tmp_path):
    docs = [(i, "alpha " * (1 + i % 3)) for i in range(700)]
    d = written(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(1, "alpha beta")], "item_id long, text string"))
    got = Q["r11_candidates"](spark, d).collect()
    assert sorted((r["rank"], r["id"], r["matched"]) for r in got) == [(i + 1, i, 1) for i in range(600)]


def test_outcome_reads_35000_characters_then_the_whole(spark, tmp_path):
    docs = [(1, "Token" + "x" * 4000), (2, "token" + "x" * 36000), (3, "token" + "x" * 36000 + "!!"), (4, "!!" + "x" * 36000), (5, "!!" + "x" * 34998), (6, None), (7, "!!token" + "x" * 36000)]
    d = written(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = {r["doc_id"]: r["outcome"] for r in Q["x33_outcome_tail"](spark, d).collect()}
    assert got == {1: "secret", 2: "secret before", 3: "loud", 4: "loud before", 5: "loud", 6: "plain", 7: "secret before"}


def test_present_value_gathers_no_lists(spark):
    plan = Q["m09_present_value"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "row_number" in plan

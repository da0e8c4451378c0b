import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.functions import scores, text
from lexmill.operators import changes, graphs, merging, quality, ranking, temporal, trust


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers_in_both_conventions(spark):
    for raw, want in (("1.234,50", 1234.5), ("1,234.50", 1234.5), ("12", 12.0), ("1.234", 1234.0), ("-3,5", -3.5), ("none", None)):
        assert one(spark, text.number(F.lit(raw))) == want


def test_half_up_and_ladder(spark):
    assert one(spark, scores.half_up(F.lit(-2.5))) == -2.0
    assert one(spark, scores.half_up(F.lit(2.5))) == 3.0
    assert one(spark, scores.ladder(F.lit(40.0), ((85, "a"), (40, "b")), "c")) == "b"


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]


def test_two_as_of_rules_differ_at_the_end(spark):
    day, start, end = (F.lit(x).cast("date") for x in ("2020-01-31", "2020-01-01", "2020-01-31"))
    assert one(spark, temporal.valid_on(day, start, end)) is True
    assert one(spark, temporal.status_on(day, start, end)) == "ended"
    assert one(spark, temporal.valid_on(day, F.lit(None).cast("date"), F.lit(None).cast("date"))) is True


def test_as_of_takes_the_latest_start_before(spark):
    facts = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 7)], "k string, t int")
    versions = spark.createDataFrame([("a", 2, 20), ("a", 10, 100)], "k string, s int, v int")
    got = {(r["k"], r["t"]): r["v"] for r in temporal.as_of(facts, versions, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("a", 5): 20, ("a", 10): 100, ("a", 1): None, ("b", 7): None}


def test_merge_keeps_first_non_null_and_reports_conflicts(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "b", "y"), (2, 1, "", "z")], "k int, o int, a string, b string")
    best = {r["k"]: (r["a"], r["b"]) for r in merging.prefer(rows, ["k"], [F.asc("o")]).collect()}
    assert best == {1: ("b", "x"), 2: ("", "z")}
    assert [tuple(r) for r in merging.conflicts(rows, ["k"], ["a", "b"], F.col("o")).collect()] == [(1, "b", "x", "y")]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, merging.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, merging.insert_ignore(base, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_reach_stops_and_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in graphs.reach(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_reach_of_many_seeds_keeps_a_row_for_64_of_them(spark, monkeypatch):
    held, settle = [], graphs.settle

    def counted(df, what):
        out = settle(df, what)
        held.append((what, out.count()))
        return out

    monkeypatch.setattr(graphs, "settle", counted)
    links = [(i, 1000 + j) for i in range(100) for j in range(i % 3, 30, 3)]
    edges, seeds = spark.createDataFrame(links, "src int, dst int"), spark.createDataFrame([(i,) for i in range(100)] * 2, "node int")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for s in range(100):
        seen = front = {s}
        want.add((s, s, 0))
        for hop in (1, 2, 3):
            front = {y for x in front for y in near[x]} - seen
            seen = seen | front
            want |= {(s, x, hop) for x in front}
    got = [tuple(r) for r in graphs.reach(edges, seeds, 3).collect()]
    assert len(got) == len(want) and set(got) == want
    blocks = 100 // 64 + 1 + spark.sparkContext.defaultParallelism  # the last row of each range is not full
    assert max(n for what, n in held if what == "front") <= 100 * blocks < len(want)


def test_chain_ends(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "node int, next int")
    got = {r["node"]: (r["last"], r["steps"]) for r in graphs.chain_ends(links).collect()}
    assert got == {i: (9, 9 - i) for i in range(1, 9)}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (7, 8)], "node int, next int")
    assert [tuple(r) for r in graphs.chain_ends(circle).collect()] == [(7, 8, 1)]


def test_gaps_and_runs(spark):
    rows = spark.createDataFrame([("s", n) for n in (1, 2, 3, 4, 6, 7, 8, 9, 12)], "s string, n int")
    assert [tuple(r) for r in quality.gaps(rows, ["s"], "n").collect()] == [("s", 1, 12, 9, 3)]
    assert sorted(map(tuple, quality.missing_runs(rows, ["s"], "n").collect())) == [("s", 5, 5), ("s", 10, 11)]


def test_fingerprint_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (2, "x")], "k int, v string")
    got = changes.fingerprint(a, ["k"], F.col("v")).collect()
    assert len({(r["n"], r["digest"]) for r in got}) == 1


def test_first_snapshot_is_silent(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "z")], "k int, t int, s string")
    assert [(r["k"], r["t"], r["before"]) for r in changes.alerts(rows, ["k"], "t", "s").collect()] == [(1, 3, "a")]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, id int, rank int")
    gold = spark.createDataFrame([(1, 11, 1), (1, 99, 1)], "qid int, id int, grade int")
    r = ranking.retrieval_metrics(ranked, gold, 3).first()
    assert (r["hits"], r["mrr"], r["recall"]) == (1, 0.5, 0.5) and r["ndcg"] == pytest.approx(0.6309 / (1 + 0.6309), abs=1e-3)


def test_dates_stay_dates(spark):
    v = temporal.intervals(spark.createDataFrame([(1, dt.date(2020, 1, 1)), (1, dt.date(2021, 1, 1))], "k int, d date"), ["k"], "d", "d")
    assert sorted((r["d"].year, r["valid_to"] and r["valid_to"].year) for r in v.collect()) == [(2020, 2021), (2021, None)]


def test_citations_are_validated(spark):
    claims = spark.createDataFrame([
        (1, 1, "Rates rose to seven percent [S:a]"), (1, 2, "Nothing here matches [S:a]"), (1, 3, "Rates rose [S:zz] [S ?]"),
        (2, 1, "Seven percent rates [S:a]"), (3, 1, "Rates rose to seven percent [S:b]"),
    ], "answer_id int, claim_id int, body string")
    sources = spark.createDataFrame([("a", "the rates rose to seven percent", True), ("b", "rates rose to seven percent", False)], "source_id string, body string, eligible boolean")
    got = {r["answer_id"]: (r["claims"], r["cited"], r["unknown"], r["malformed"], r["supported"], r["valid"]) for r in trust.validate(claims, sources).collect()}
    assert got == {1: (3, 3, 1, 1, 1, False), 2: (1, 1, 0, 0, 1, True), 3: (1, 1, 1, 0, 0, False)}


def test_as_of_takes_null_values_of_the_latest_version(spark):
    versions = spark.createDataFrame([(1, 1, 20), (1, 3, None), (1, 8, 7)], "k int, since int, rate int")
    facts = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (1, 9), (2, 5)], "k int, at int")
    got = temporal.as_of(facts, versions, ["k"], "at", "since", ["rate"]).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 0, None), (1, 2, 20), (1, 5, None), (1, 9, 7), (2, 5, None)])

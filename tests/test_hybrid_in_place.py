import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexmill.functions import text as T
from lexmill.operators import hybrid, in_place, postings, ranking
from lexmill.sources.files import scratch

WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[(i * k) % 6] for k in range(1, 2 + i % 5)) if i % 7 else "") for i in range(60)], "id long, body string")
    asks = spark.createDataFrame([(1, "amber birch"), (2, "cedar cedar ember"), (3, "nowhere")], "qid long, text string").select("qid", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    probes = asks.select("qid", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 5, 14, 33, 59)])).alias("id"))
    return docs, asks, probes


def test_best_and_ahead_are_a_sort():
    rng = np.random.default_rng(7)
    ids, value = rng.permutation(90), np.round(rng.random((3, 90)), 1)
    there = rng.random((3, 90)) < 0.8
    best, asked = in_place.Best(3, 11), (np.repeat(np.arange(3), 30), np.tile(ids[:30], 3), value[:, :30].ravel())
    ahead = np.zeros(90, np.int64)
    for at in range(0, 90, 20):
        some = slice(at, at + 20)
        best.add(ids[some], value[:, some], there[:, some])
        ahead += in_place.ahead(ids[some], value[:, some], there[:, some], asked)
    for q in range(3):
        order = sorted((-v, i) for v, i, t in zip(value[q], ids, there[q]) if t)
        assert [(-v, i) for v, i in zip(best.value[best.i == q], best.ids[best.i == q])] == order[:11]
        assert ahead[q * 30 : q * 30 + 30].tolist() == [sum(o < (-v, i) for o in order) for i, v in zip(ids[:30], value[q])]


def test_lexical_places_both_ways(spark, small, monkeypatch):
    docs, asks, probes = small
    index = postings.build(docs, scratch(spark, "index"))
    got = []
    for terms, turn in ((200_000, 500_000), (200_000, 4), (0, 500_000)):
        monkeypatch.setattr(postings, "TERMS_A_TASK", terms)
        monkeypatch.setattr(in_place, "PROBES_A_TASK", turn)
        first, place = postings.grading(spark, index, asks, docs.select("id"))
        graded = first(probes, 3)
        lex = graded.where("probed").select("qid", "id", F.round("lex", 6).alias("lex"))
        top = ranking.top(graded.where("NOT probed"), "lex", 3).select("qid", "id", F.round("lex", 6))
        behind = probes.join(graded.where("probed").drop("probed"), ["qid", "id"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
        got.append([sorted(map(tuple, x.collect())) for x in (lex, top, place(behind).select("qid", "id", "place"))])
        # postings stay where they are
        assert ("Exchange" in plan_of(graded)) == (terms == 0)
    assert got[0] == got[1] == got[2] and all(got[0])
    # a question without known terms orders all documents by id
    assert [(i, p) for q, i, p in got[0][2] if q == 3] == [(0, 1), (5, 6), (14, 15), (33, 34), (59, 60)]


def test_dense_places_both_ways(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0] if i % 9 else None) for i in range(80)] + [(99, [0.0, 0.0, 0.0])], "id long, v array<float>")
    asks = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 1.0]), (3, None)], "qid long, v array<float>")
    got = []
    for most in (4_096, 0):
        monkeypatch.setattr(ranking, "QUERIES_A_TASK", most)
        top = ranking.dense_top(vectors, asks, 7)
        probes = ranking.dense_top(vectors, asks, 70).where("rank > 7").select("qid", "id", "cosine")
        places = ranking.dense_places(vectors, asks, probes)
        got.append([sorted(map(tuple, x.select("qid", "id", n).collect())) for x, n in ((top, "rank"), (places, "ahead"))])
        assert ("MapInArrow" in plan_of(top)) == (most > 0)
        assert {(q, i): r - 1 for q, i, r in ranking.dense_top(vectors, asks, 70).where("rank > 7").select("qid", "id", "rank").collect()} == {(q, i): a for q, i, a in got[-1][1]}
    assert got[0] == got[1] and got[0][0]


def test_names_both_ways(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "a long name of a thing"), (3, "thing"), (4, "a long name of another")], "id long, name string")
    q = spark.createDataFrame([(7, "said abc and a long name of a thing"), (8, "long name"), (9, "")], "qid long, said string")
    ways = [sorted(map(tuple, hybrid.naming(docs, q, most).collect())) for most in (1 << 20, 40)]
    assert ways[0] == ways[1] == [(7, 1), (7, 2), (7, 3), (8, 2), (8, 4)]


def test_facets_shuffle_neither_texts_nor_postings(spark, monkeypatch):
    plans = []

    def noted(df, what, settle=hybrid.settle):
        plans.append((what, df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")))
        return settle(df, what)

    for module in (hybrid, postings):
        monkeypatch.setattr(module, "settle", noted)
    out = __spark_entry__.queries()["a12_facets_of_relevant"](spark, "/root/testdata/sf0.001")
    noted(out, "facets", lambda df, what: df)
    # a first shuffle deals the rows of one small file over the cores; cited documents are few
    sent = [(what, cols) for what, plan in plans for cols, how in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", plan) if not how.startswith("RoundRobin")]
    assert sent and not [x for x in sent if x[0] != "cited-pairs" and re.search(r"\b(text|body|ts|tokens|tfs|tf|w)#", x[1])]

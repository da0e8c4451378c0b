import pytest
from pyspark.sql import functions as F

from lexmill.operators import fielded, postings
from lexmill.plans import retrieval
from lexmill.sources.files import scratch

SF = "/root/testdata/sf0.001"


def built(spark, docs):
    return postings.build(docs, scratch(spark, "index"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return retrieval._inputs(spark, SF)


def test_both_ways_agree(spark, inputs, monkeypatch):
    docs, asks = inputs
    index = built(spark, docs)
    rankings = (
        lambda: postings.bm25_top(spark, index, asks, 7).select("qid", "id", F.round("bm25", 6), "matched", "rank"),
        lambda: postings.bm25_top(spark, index, asks, 5, "matched").select("qid", "id", F.round("bm25", 6), "matched", "rank"),
        lambda: postings.bm25_all(spark, index, asks).select("qid", "id", F.round("bm25", 6), "matched"),
        lambda: postings.cosine_top(spark, index, asks, 7, True).select("qid", "id", F.round("score", 6), "rank"),
    )
    for ranking in rankings:
        monkeypatch.setattr(postings, "TERMS_A_TASK", 200_000)
        monkeypatch.setattr(postings, "_CELLS", 4_000)  # several slices and trims
        here = sorted(map(tuple, ranking().collect()))
        monkeypatch.setattr(postings, "TERMS_A_TASK", 0)
        assert here == sorted(map(tuple, ranking().collect())) and here


def test_postings_are_not_shuffled(spark, inputs):
    docs, asks = inputs
    index = built(spark, docs)
    assert "Exchange" not in plan_of(postings.bm25_all(spark, index, asks))
    assert "Exchange" not in plan_of(index.read(spark, "postings"))


def test_repeated_ids_are_brought_together(spark, inputs):
    _, asks = inputs
    docs = spark.createDataFrame([(1, "alpha beta beta"), (1, "beta gamma delta"), (2, "beta"), (3, None)], "id long, body string")
    index = built(spark, docs)
    assert not index.unique and index.docs == 4
    got = postings.bm25_all(spark, index, spark.createDataFrame([(9, "beta")], "qid long, body string"))
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == [(9, 1), (9, 2)]
    one = {(r["token"], r["id"]): r["tf"] for r in index.read(spark, "postings").collect()}
    assert one[("beta", 1)] == 3


def test_an_empty_index(spark):
    index = built(spark, spark.createDataFrame([], "id long, body string"))
    assert postings.bm25_top(spark, index, spark.createDataFrame([(9, "beta")], "qid long, body string"), 3).count() == 0


def test_fielded_rows_stay_where_they_are(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)}gamma{i % 3}", f"beta{i % 2} Älpha" if i % 5 else None) for i in range(40)], "id long, body string, title string")
    asks = spark.createDataFrame([(1, "beta gamma1 gamma1"), (2, "alpha beta0"), (3, "none")], "qid long, body string")
    index, weights = fielded.build(pages, ["body", "title"], scratch(spark, "fielded")), {"body": 8.0, "title": 3.0}
    ranked = lambda: fielded.search(spark, index, asks, weights, 6).select("qid", "id", F.round("score", 6), "matched", "rank")
    here, plan = sorted(map(tuple, ranked().collect())), plan_of(fielded.search(spark, index, asks, weights, 6))
    assert index.unique and "MapInArrow" in plan and "CoGroups" not in plan
    monkeypatch.setattr(postings, "TERMS_A_TASK", 0)
    assert here == sorted(map(tuple, ranked().collect())) and len(here) == 12
    # rows of one id are brought together
    twice = fielded.build(pages.union(pages.where("id = 3")), ["body", "title"], scratch(spark, "fielded"))
    assert not twice.unique and twice.docs == 41
    assert {r["id"] for r in fielded.search(spark, twice, asks, weights, 50).where("qid = 2").collect()} == set(range(40))

from pyspark.sql import functions as F
import pytest

from lexmill.functions import citations, parsing, structure
from lexmill.operators import filters, graphs, matching, postings, ranking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_units_of_a_body(spark):
    body = ["Preamble", "CHAPTER I", "Article 1", "(1) first", "(2) second", "Article 2", "text", "CHAPTER II", "more"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(body)] + [(2, 0, "Article 9"), (2, 1, "")], "doc long, at long, line string")
    levels = {"chapter": r"^CHAPTER ([IVX]+)$", "article": r"^Article ([0-9]+)$", "paragraph": r"^\(([0-9]+)\) "}
    got = {(r["doc"], r["at"]): (r["chapter"], r["article"], r["paragraph"]) for r in structure.units(lines, "doc", "at", "line", levels).collect()}
    none = (None, None, None)
    want = [none, ("I", None, None), ("I", "1", None), ("I", "1", "1"), ("I", "1", "2"), ("I", "2", None), ("I", "2", None), ("II", None, None), ("II", None, None)]
    assert [got[1, i] for i in range(len(body))] == want
    assert got[2, 0] == got[2, 1] == (None, "9", None)
    assert one(spark, structure.unit_id(F.lit(7), {"c": F.lit("I"), "a": F.lit(None).cast("string")}, F.lit(3))) == "7-cI"
    assert one(spark, structure.unit_id(F.lit(7), {"c": F.lit(None).cast("string")}, F.lit(3))) == "7-block3"


def test_references_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, "é Rule No 7 of 1999, of 1998 and 8/2001"), (2, None), (3, "none")], "id long, t string")
    patterns = {"named": r"Rule No \d+ of \d{4}", "coded": r"\d+/\d{4}", "bare": r"of \d{4}"}
    got = sorted(map(tuple, structure.references(rows, "id", "t", patterns).collect()), key=str)
    assert got == [(1, "bare", 21, 28, "of 1998"), (1, "coded", 33, 39, "8/2001"), (1, "named", 2, 19, "Rule No 7 of 1999")]


def test_citation_signals(spark):
    for text, want in (
        ("PMK Nomor 007 Tahun 2010 dan UU 8/1983", ["pmk-7-2010", "uu-8-1983"]), ("132/KMK.014/2000 and PMK 5 2001", ["kmk-132-2000"]),
        ("PER-17/PJ/2015", ["per-17-2015"]), ("SE 4 PJ 9 1999", ["se-4-1999"]), ("chapter 5 1999", []), (None, []),
        ("UU Nomor 8 Tahun 1983 PPN", ["uu-8-1983"]), ("PMK No. 141/PMK.03/2015", ["pmk-141-2015"]), ("SE-23/PJ.52/1995", ["se-23-1995"]),
        ("uu nomor dan tahun 1983", []), ("superpmk 5 2001", []), ("PMK12/2010, PMK12/2010", ["pmk-2010-2010"]), ("PMK12/2010", ["pmk-12-2010"]), ("pp 55 tahun 22", []),
        ("uu uu 7 th 2021", ["uu-7-2021"]), ("pp 5 pmk nomor 6 tahun 2020", ["pmk-6-2020"]), ("KEP 1990 2000", ["kep-1990-2000"]), ("pmk 000/2001", ["pmk-0-2001"]),
    ):
        assert one(spark, citations.signals(F.lit(text).cast("string"))) == want, text


def test_fields(spark):
    assert one(spark, parsing.grouped_number(F.lit("1.234.567,5"))) == 1234567.5
    assert one(spark, parsing.inline_items(F.lit("x (a) one (b) two"))) == ["x", "(a) one", "(b) two"]
    assert one(spark, parsing.inline_items(F.lit("x (a) one"))) == ["x (a) one"]
    assert one(spark, parsing.clip(F.lit("abcdef"), 4)) == "abc…" and one(spark, parsing.clip(F.lit("abc"), 4)) == "abc"
    p = one(spark, parsing.period(F.lit(20), F.lit(12), F.lit(None).cast("int"), F.lit(5), F.lit(1), F.lit(2021)))
    assert (p["start"].isoformat(), p["end"].isoformat()) == ("2020-12-20", "2021-01-05")
    assert [one(spark, parsing.iso_day(F.lit(s))) for s in ("2020-02-03", "03/02/2020", "3 February 2020", "soon")] == ["2020-02-03"] * 3 + [""]
    assert [one(spark, parsing.amendment_ordinal(F.lit(s))) for s in ("Third Amendment of X", "an amendment", "X")] == [3, 1, None]


def test_predicates(spark):
    with pytest.raises(ValueError):
        filters.visible(F.lit("public"), F.lit("a"), " ")
    assert one(spark, filters.visible(F.lit("tenant"), F.lit(None).cast("string"), "a")) is False
    assert [one(spark, filters.secure_host(F.lit(u), ("x.org",))) for u in ("https://x.org/a", "https://b.x.org", "http://x.org", "https://ax.org")] == [True, True, False, False]
    assert one(spark, filters.in_scope({"m": F.lit(None).cast("string")}, {"m": None})) is True
    assert [one(spark, filters.between_or_open(F.lit(y).cast("int"), 1990, 2000)) for y in (None, 1990, 2001)] == [True, True, False]


def test_matching(spark):
    left = spark.createDataFrame([(1, "abcdefg"), (2, "zzzzzz"), (3, "cdefg")], "i long, a string")
    right = spark.createDataFrame([(7, "cdefg"), (8, "xzzzzzzx")], "j long, b string")
    assert sorted((r["i"], r["j"]) for r in matching.containing(left, "a", right, "b", 5).collect()) == [(1, 7), (2, 8), (3, 7)]


def test_walks(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "node long, next long")
    starts = spark.createDataFrame([(1,), (4,), (9,)], "node long")
    assert sorted(map(tuple, graphs.walk(links, starts).collect())) == [(1, 1), (1, 2), (1, 3), (4, 5)]
    assert sorted(r["node"] for r in graphs.descendants(links, starts.where("node = 4")).collect()) == [5]


def test_places_are_row_numbers(spark):
    rows = spark.range(500).selectExpr("id % 7 AS q", "id", "cast((id * 37) % 101 AS double) / 10 AS s")
    want = {(r["q"], r["id"]): r["rank"] for r in ranking.top(rows.withColumnRenamed("q", "qid"), "s", 1000).withColumnRenamed("qid", "q").collect()}
    assert {(r["q"], r["id"]): r["rank"] for r in ranking.places(rows, ["q"], "s", "id", 0.7).collect()} == want


def test_index_equals_the_plain_ranking_and_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 2 + i % 9))) for i in range(60)] + [(99, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    asks = spark.createDataFrame([(1, "w1 w5 w7 nothing"), (2, "w2 w2"), (3, "")], "qid long, body string")
    read = lambda: spark.read.parquet(path).selectExpr("doc_id AS id", "coalesce(text, '') AS body")
    index = postings.index_of(spark, str(tmp_path), read())
    assert postings.index_of(spark, str(tmp_path), read()) is index
    plain = ranking.top(ranking.bm25(read(), asks).withColumn("s", F.round("bm25", 6)), "s", 5)
    want = {(r["qid"], r["id"], r["rank"]): round(r["bm25"], 9) for r in plain.collect()}
    assert {(r["qid"], r["id"], r["rank"]): round(r["bm25"], 9) for r in postings.bm25_top(spark, index, asks, 5).collect()} == want
    every = {(r["qid"], r["id"]): (round(r["bm25"], 9), r["matched"]) for r in ranking.bm25(read(), asks).collect()}
    assert {(r["qid"], r["id"]): (round(r["bm25"], 9), r["matched"]) for r in postings.bm25_all(spark, index, asks).collect()} == every
    spark.createDataFrame([(200, "w1")], "doc_id long, text string").write.mode("append").parquet(path)
    assert postings.index_of(spark, str(tmp_path), read()).docs == 62

import pytest
from pyspark.sql import functions as F

from lexmill.functions import pages
from lexmill.operators import imports, staged

HTML = """<html LANG='id'><head><meta content="P" property="og:title"><meta name='x'></head><h1 class=a>One <b>two</b></h1>
<script type="application/json">{"a": {"b": [1, "2"]}, "n": 5}</script><script>{"a": 1}</script><SCRIPT TYPE=application/ld+json>{"n": "late", "c": null}</SCRIPT>
<script type="text/javascript">x</script><script type='application/json'>{broken</script><script type="application/json"> </script>"""


def test_page_fields(spark):
    rows = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>none")], "id long, html string")
    h = F.col("html")
    markup = rows.select(pages.attribute(h, "html", "lang"), pages.meta(h, "og:title"), pages.meta(h, "x"), pages.inner(h, "h1")).first()
    assert tuple(markup) == ("id", "P", None, "One two")
    found, aside = pages.fields(rows, "id", "html", {"deep": ("$.zz", "$.a.b[1]"), "n": ("$.n",), "gone": ("$.c", "$.a.b.c")})
    assert sorted(map(tuple, found.collect())) == [(1, "2", "5", None), (2, None, None, None), (3, None, None, None)]
    assert sorted(tuple(r)[:3] for r in aside.collect()) == [(1, 2, "malformed"), (1, 3, "empty")]


def tables(spark, n):
    a = spark.createDataFrame([(i % 5, None if i % 2 else "x") for i in range(n)], "k long, v string")
    return {"a": a, "b": a.where("k = 1"), "none": a.where("k > 99")}


def content(spark, path):
    return {n: sorted(map(str, imports.read(spark, path, n).collect())) for n in ("a", "b", "none")}


def test_a_repeated_import_is_no_version(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    assert imports.current(spark, path) == (0, None)
    assert imports.write_all(tables(spark, 20), path) == 1
    assert imports.write_all({n: t.orderBy("k").repartition(2) for n, t in tables(spark, 20).items()}, path) == 1
    first = content(spark, path)
    assert len(first["a"]) == 20 and first["none"] == []
    assert imports.write_all(tables(spark, 21), path) == 2 and len(content(spark, path)["a"]) == 21
    twice = {n: t.union(t) for n, t in tables(spark, 20).items()}
    assert imports.write_all(twice, path) == 3  # repeated rows count


def test_a_killed_import_leaves_the_old_set(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    imports.write_all(tables(spark, 20), path)
    before = content(spark, path)
    dying = tables(spark, 30) | {"z": spark.range(1).select(F.raise_error(F.lit("killed")).alias("x"))}
    with pytest.raises(Exception, match="killed"):
        imports.write_all(dying, path)
    tables(spark, 7)["a"].write.parquet(f"{path}/v2/a")  # what a run leaves that dies between its tables
    assert content(spark, path) == before and imports.current(spark, path)[0] == 1
    assert imports.write_all(tables(spark, 30), path) == 2 and len(content(spark, path)["a"]) == 30


def test_absorbing_twice_changes_nothing(spark):
    base = spark.createDataFrame([("k1", "one", None), ("k2", "", "q"), ("k3", None, None)], "key string, title string, kind string")
    rows = spark.createDataFrame([(1, "k1", "ONE", "new"), (2, "k2", "two", "r"), (3, "k2", "again", "r"), (4, None, "lost", "r"), (5, "k9", None, "w"), (6, "k3", "", None)], "place long, id string, title string, kind string")
    taken, log = imports.absorb(base, rows.drop("id").join(rows.select("place", "id"), "place"), F.col("id"))
    taken = taken.select("key", "title", "kind")
    want = [("k1", "one", "new"), ("k2", "two", "q"), ("k3", None, None), ("k9", None, "w")]
    assert sorted(map(tuple, taken.collect())) == want
    said = {r["place"]: r["outcome"] for r in log.collect()}
    assert said == {1: "filled", 2: "filled", 3: "skipped: repeated in the batch", 4: "skipped: no identity", 5: "inserted", 6: "unchanged"}
    again, log = imports.absorb(taken, rows, F.col("id"))
    assert sorted(map(tuple, again.select("key", "title", "kind").collect())) == want
    assert {r["outcome"].split(":")[0] for r in log.collect()} == {"unchanged", "skipped"}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stages_of_the_retriever(spark):
    pair = "qid long, record long"
    terms = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "qid long, token string")
    more = frame(spark, [("a", "z"), ("z", "far"), ("c", "c"), ("b", "")], "token string, added string")
    assert sorted(map(tuple, staged.expanded(terms, more).collect())) == [(1, "a"), (1, "b"), (1, "z"), (2, "c")]
    hits = frame(spark, [(1, 10, 5, 2.0, "a"), (1, 10, 5, 2.0, "b"), (1, 11, 5, 3.0, "a"), (1, 12, 6, 3.0, "b"), (2, 10, 5, 1.0, "c")], "qid long, id long, record long, bm25 double, token string")
    units = staged.best_units(hits, terms)
    assert sorted(map(tuple, units.collect())) == [(1, 5, 3.0, 0, 2), (1, 6, 3.0, 1, 1), (2, 5, 1.0, 0, 1)]
    assert sorted(map(tuple, staged.best_units(hits, terms, 1).collect())) == [(1, 5, 3.0, 0, 1), (2, 5, 1.0, 0, 1)]
    records = frame(spark, [(5, ["a"], 1.0, "uu", 0.0), (6, ["x"], 0.0, "pp", 0.0), (7, ["b", "a", "b"], 0.0, "pp", 9.0), (8, [], 0.0, "uu", 0.0)], "record long, title array<string>, own double, kind string, bonus double")
    named = staged.titles(terms, records)
    assert sorted(map(tuple, named.collect())) == [(1, 5, 1), (1, 7, 2)]
    pinned = frame(spark, [(1, 8), (1, 99), (2, 8)], pair)
    found = staged.direct(units, named, terms, pinned, records)
    want = {(1, 5): 3 + 8 + 32 + 1, (1, 6): 3 + 16 - 0.002, (1, 7): 36 + 48 - 12.0, (1, 8): 10_000.0, (2, 5): 1 + 32 + 1.0, (2, 8): 10_000.0}
    assert {(r["qid"], r["record"]): round(r["score"], 6) for r in found.collect()} == want
    far = frame(spark, [(1, n, 100.0 - n) for n in range(1, 100)] + [(2, 1, 10.0)], "qid long, record long, score double")
    known = frame(spark, [(n,) for n in range(1, 200)], "record long")
    edges = frame(spark, [(1, 50), (2, 50), (50, 150), (150, 151), (1, 300), (1, 2), (40, 160)], "a long, b long")
    rows = {(r["qid"], r["record"]): (round(r["score"], 6), r["hop"], r["rank"]) for r in staged.along_edges(far, edges, known).collect()}
    assert rows[1, 50] == (61.38, 1, 50) and rows[1, 150] == (round(61.38 * 0.42, 6), 2, None) and (1, 151) not in rows and (1, 300) not in rows
    assert rows[1, 2] == (98.0, 0, 2) and (1, 160) not in rows and (1, 81) not in rows and len([k for k in rows if k[0] == 1]) == 81
    assert rows[2, 2] == (6.2, 1, None) and rows[2, 50] == (6.2, 1, None) and rows[2, 150][1] == 2
    some = frame(spark, [(1, 5, 9.0, 0, 1), (1, 6, 8.0, 0, 2), (1, 7, 3.0, 1, None), (1, 8, 1.0, 2, None), (2, 5, 1.0, 0, 1)], "qid long, record long, score double, hop int, rank int")
    slots = frame(spark, [(1, "uu", 2)], "qid long, kind string, quota int")
    links = frame(spark, [(8, 5), (7, 99)], "a long, b long")
    got = staged.selected(some, records, slots, links, 3).orderBy("qid", "place").collect()
    assert [(r["qid"], r["record"], r["place"]) for r in got] == [(1, 8, 1), (1, 5, 2), (2, 5, 1)]

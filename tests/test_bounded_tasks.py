from pyspark.sql import functions as F

from lexmill.functions import gates
from lexmill.operators import imports, merging, statutes
from lexmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_second_import_is_dealt_over_all_partitions(spark, monkeypatch):
    seen, write_all = [], imports.write_all
    monkeypatch.setattr(imports, "write_all", lambda tables, path: seen.append(tables) or write_all(tables, path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = registry.queries()["k08_committed_import"](spark, SF).collect()
        assert {t.rdd.getNumPartitions() for t in seen[1].values()} == {4}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["version"] for r in rows} == {1}


def test_merged_batches_take_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(merging, "ROWS_A_TASK", 100)
    batches = [spark.range(b, 1000 + b).select((F.col("id") % 700).alias("k"), F.col("id").alias("v")) for b in (0, 5)]
    got = merging.merge_batches(batches, ["k"], [F.max("v").alias("v"), F.count("*").alias("n")])
    assert got.rdd.getNumPartitions() == 20
    want = {}
    for v in [*range(1000), *range(5, 1005)]:
        m, n = want.get(v % 700, (0, 0))
        want[v % 700] = max(m, v), n + 1
    assert {r["k"]: (r["v"], r["n"]) for r in got.collect()} == want


def test_rate_rows_read_a_text_once(spark):
    plan = spark.range(1).select(gates.rate_rows(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 5


def test_lines_of_statutes_are_never_rows(spark):
    rows = spark.createDataFrame([(1, "Pasal 1\nsatu"), (2, "BAB I X\nPasal 1\n(1) b"), (2, "Pasal 2\nc"), (None, None)], "k int, t string")
    units = statutes.units(rows, "k", "t")
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Window [") == 1
    # the rows of key 2 are one text, in the order of the texts
    got = [(r["key"], r["seq"], r["path"], r["text"]) for r in units.orderBy("key", "seq").collect()]
    assert got == [(1, 1, "Pasal 1", "satu"), (2, 1, "BAB I X > Pasal 1 > ayat (1)", "b"), (2, 2, "BAB I X > Pasal 2", "c")]


def test_texts_are_read_once_for_all_relations(spark, monkeypatch):
    from lexmill.operators import relations

    read, settle = [], relations.settle
    monkeypatch.setattr(relations, "settle", lambda df, what: read.append(what) or settle(df, what))
    edges = registry.queries()["x24_relations"](spark, SF)
    assert read == ["marks"]
    # of the plan's table functions only that of the titles is left
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [m[1] for m in relations.marks_in("Satu dua. Tiga dicabut. Empat")] == ["repeal", "sentence"]

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import chunks
from lexmill.plans import registry
from lexmill.sources import files

SCHEMA = T.StructType().add("id", "long").add("title", "string")


def test_jsonl_sets_bad_lines_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "title": "x"}\nnot json\n{"id": 2}\n{"id": 3, "title": ""}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path), SCHEMA, ("title",))
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing title", "missing title", "no JSON object"]


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None)], SCHEMA)
    files.write_jsonl(rows, str(tmp_path / "out"))
    good, bad = files.read_jsonl(spark, str(tmp_path / "out"), SCHEMA)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and bad.count() == 0


def test_missing_table_has_no_rows(spark):
    assert files.read_table_if_there(spark, "no_such_table", SCHEMA).collect() == []


def test_csv_header_is_found(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Report 2024,,\n,,\nNo,Title,Title\n1,a,b\n,,\n2,c,d\n")
    df = files.read_csv_matrix(spark, str(tmp_path / "m.csv"), {"no": 5, "title": 4})
    assert df.columns == ["No", "Title", "Title_2"] and sorted(map(tuple, df.collect())) == [("1", "a", "b"), ("2", "c", "d")]


def test_replace_source_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_source(spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int"), path, "source")
    files.replace_source(spark.createDataFrame([("a", 3)], "source string, v int"), path, "source")
    assert sorted((r["source"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path)).collect()] == [("x.bin", 3, hashlib.sha256(b"abc").hexdigest())]


def packed(parts, limit, overlap):
    done, now = [], ""
    for p in parts:
        if now == "" or len(now) + 1 + len(p) <= limit:
            now = p if now == "" else now + "\n" + p
        else:
            done.append(now)
            now = now[-overlap:] + "\n" + p if overlap else p
    return done + [now] if now else done


@pytest.mark.parametrize("overlap", [0, 7])
def test_packed_chunks(spark, overlap):
    texts = ["", "one", "a b c\n\nlonger paragraph here\nx\n" * 5, "w" * 100 + "\nshort\n" + "v" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(chunks.packed(chunks.paragraphs(F.col("t")), 40, overlap)).collect()]
    want = [packed([p.strip(" ") for p in t.split("\n") if p.strip(" ")], 40, overlap) for t in texts]
    assert got == want


@pytest.mark.parametrize("name, limit, overlap", [("x01_paragraph_chunks", 1800, 180), ("x03_fallback_chunks", 9000, 0)])
def test_chunk_query_covers_all_documents(spark, name, limit, overlap):
    sf = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], i, hashlib.md5(c.encode()).hexdigest()) for r in docs for i, c in enumerate(packed([p.strip(" ") for p in (r["text"] or "").split("\n") if p.strip(" ")], limit, overlap))}
    assert {(r["doc_id"], r["chunk_no"], r["chunk_md5"]) for r in got.collect()} == want


def test_csv_rows_equal_to_the_heading_stay(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Report,2024\nid,name\n1,a\nReport,2024\nid,name\n\n2,b\n")
    got = files.read_csv_matrix(spark, str(tmp_path / "m.csv"), {"id": 5, "name": 3})
    assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == sorted([("1", "a"), ("Report", "2024"), ("id", "name"), ("2", "b")])

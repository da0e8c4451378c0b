"""Comparison of a query's rows with DuckDB's for its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(table):
    cols = sorted(table.column_names)
    return cols, sorted([plain(r[c]) for c in cols] for r in table.to_pylist())


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = rows_of(query(spark, sf_dir).toArrow()), rows_of(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]

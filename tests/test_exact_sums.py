import datetime as dt
from fractions import Fraction

import duckdb
import pytest

from lexmill.plans import registry


def rows_of(spark, tmp_path, events, name):
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(4).write.parquet(path)
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(registry.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = registry.queries()[name](spark, str(tmp_path)).toArrow().to_pylist()
    by = lambda rows: sorted(tuple(r.values()) for r in rows)
    assert by(got) == by(want)
    return by(got)


def test_the_limit_is_reached_exactly(spark, tmp_path):
    # ten times 0.1 is less than 1 in doubles
    values = [1499.0] + [0.1] * 10 + [5.0]
    events = [(i, dt.datetime(2024, 1, 1, 0, i), 1, "view", v) for i, v in enumerate(values)]
    got = rows_of(spark, tmp_path, events, "t10_budget_guard")
    assert [r[2] for r in got] == [False] * 11 + [True]
    assert got[10][1] == 1500.0


@pytest.mark.parametrize("low", [-5000, 0])
def test_halves_of_a_score_go_up(spark, tmp_path, low):
    events, want = [], []
    for user in range(2000):
        cents = [low + (user * 7 + 13 * i) % 11000 for i in range(1 + user % 4)]
        events += [(10 * user + i, dt.datetime(2024, 1, 1), user, "abcdefg"[i], c / 100) for i, c in enumerate(cents)]
        n = k = len(cents)
        tenths = Fraction(35, 10) * min(Fraction(100), Fraction(sum(cents), 100 * n)) + 20 * n + 50 * k + 40 + 50
        want.append((user, max(0, min(1000, (tenths + Fraction(1, 2)).__floor__())) / 10))
    assert rows_of(spark, tmp_path, events, "m02_case_score") == want

"""Batch twins of the streams; the streams themselves are tested against these."""

from __future__ import annotations

from ..streaming import watch
from .base import query, table


@query("t10_daily_windows", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def t10(spark, d):
    from pyspark.sql import functions as F

    return watch.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))

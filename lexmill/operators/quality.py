"""Corpus checks, gaps, findings, votes and trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, total, failed, ratio: all checks in one scan of the rows."""
    sums = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c_{name}") for name, c in checks.items()])
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c_{n}").alias("failed")) for n in checks])
    return sums.select("total", F.inline(each)).select("check", "total", "failed", F.round(F.try_divide("failed", "total"), 6).alias("ratio"))


def gaps(rows: DataFrame, series: list[str], number: str, least: int = 8, density: float = 0.55) -> DataFrame:
    """series, low, high, have, n_missing: how many numbers between a series' ends are missing, for
    dense enough series. Counts alone decide, so no series is listed in one row."""
    g = rows.groupBy(*series).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("have"))
    span = F.col("high") - F.col("low") + 1
    return g.where((F.col("have") >= least) & (F.col("have") >= density * span)).withColumn("n_missing", span - F.col("have"))


def missing_runs(rows: DataFrame, series: list[str], number: str) -> DataFrame:
    """series, first, last of each run of missing numbers, from each number's successor."""
    from pyspark.sql import Window

    w = Window.partitionBy(*series).orderBy(number)
    d = rows.select(*series, number).distinct().withColumn("_next", F.lead(number).over(w))
    return d.where(F.col("_next") > F.col(number) + 1).select(*series, (F.col(number) + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def flags(named: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def vote(agree: Column, disagree: Column) -> Column:
    """Confidence from the number of agreeing sources: .62, .88, .94, .96; null if any disagrees."""
    return F.when(disagree > 0, None).when(agree >= 4, 0.96).when(agree == 3, 0.94).when(agree == 2, 0.88).when(agree == 1, 0.62)


def trust_score(parts: dict[str, tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in parts.values()])

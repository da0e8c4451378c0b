"""Validity intervals and as-of lookups. Two rules stand side by side and are never mixed: a
validity interval holds its last day, a status interval ends before its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Inclusive end; a null end or start is open."""
    return (F.coalesce(start, F.lit("0001-01-01").cast("date")) <= day) & (day <= F.coalesce(end, F.lit("9999-12-31").cast("date")))


def status_on(day: Column, start: Column, end: Column) -> Column:
    """Exclusive end."""
    return F.when(day < start, "not yet").when(day >= end, "ended").otherwise("in force")


def intervals(rows: DataFrame, key: list[str], start: str, tie: str) -> DataFrame:
    """Adds valid_to: the start of the key's next row, null for the last."""
    w = Window.partitionBy(*key).orderBy(start, tie)
    return rows.withColumn("valid_to", F.lead(start).over(w))


def as_of(facts: DataFrame, versions: DataFrame, key: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """Each fact with the values of the latest version that starts at or before it, null if none. A
    version's null value is a value: the version before it does not show through.

    A union of both sides sorted by time within the key, filled down: linear in the rows, where an
    inequality join would pair every fact with every version before it.
    """
    names = facts.columns
    kept = F.struct(*[F.col(v).alias(v) for v in values])
    kind = versions.select(kept.alias("v")).schema["v"].dataType
    left = facts.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_version"))
    right = versions.select(
        *[F.col(c) if c in key else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in names],
        F.col(start).alias("_at"), F.lit(0).alias("_side"), kept.alias("_version"),
    )
    w = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_version", F.last("_version", ignorenulls=True).over(w))
    return filled.where("_side = 1").select(*names, *[F.col("_version").getField(v).alias(v) for v in values])

"""Upserts, overlays, merges of records and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_TASK = 500_000


def upsert(base: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace those of their key."""
    return base.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def insert_ignore(base: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Only incoming rows of new keys are added."""
    return base.unionByName(incoming.join(base.select(*key).distinct(), key, "left_anti"))


def merge_batches(batches: list[DataFrame], key: list[str], merged: list[Column]) -> DataFrame:
    """One row of each key of all batches together. Rows are dealt by their key into parts of ROWS_A_TASK, so that
    the table of keys that a task holds does not grow with the input."""
    rows = reduce(DataFrame.unionByName, batches)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(parts, *key).groupBy(*key).agg(*merged)


def prefer(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, every field the first non-null in the order."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in rows.columns if c not in key]
    filled = rows.select(*key, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in fields], F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_n"))
    return filled.where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, key: list[str], fields: list[str], order: Column) -> DataFrame:
    """key, field, kept, other values: fields in which the rows of a key differ. The first value in
    the order is kept; blanks never conflict."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = rows.select(*key, order.alias("_o"), F.inline(each)).where("value is not null and value <> ''")
    once = long.groupBy(*key, "field", "value").agg(F.min("_o").alias("_o"))  # a value that a third of the rows share is one row
    out = once.groupBy(*key, "field").agg(F.min_by("value", "_o").alias("kept"), F.array_sort(F.collect_list("value")).alias("all"))
    return out.where(F.size("all") > 1).select(*key, "field", "kept", F.array_join(F.array_remove("all", F.col("kept")), "|").alias("others"))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def cascade(base: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the deleted keys and the rows that refer to them."""
    out = {"": base.join(gone, key, "left_anti")}
    for name, (rows, ref) in children.items():
        out[name] = rows.join(gone.select(F.col(key).alias(ref)), ref, "left_anti")
    return out

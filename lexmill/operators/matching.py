"""Matching on derived keys: unique aliases, candidates in order, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_targets(rows: DataFrame, alias: list[str], key: str) -> DataFrame:
    """alias columns, n, target: how many keys an alias stands for, and the smallest of them."""
    return rows.groupBy(*alias).agg(F.count("*").alias("n"), F.min(key).alias("target"))


def first_candidate(rows: DataFrame, id_col: str, candidates: str, known: DataFrame, on: str, target: str) -> DataFrame:
    """id, target, tier: the first of a row's candidate keys that is known, and its place."""
    each = rows.select(id_col, F.posexplode(candidates).alias("pos", on)).join(known, on)
    return each.groupBy(id_col).agg(F.min_by(target, "pos").alias(target), F.min("pos").alias("tier"))


def pieces(text, size: int):
    """All substrings of a length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, F.lit(size))))


def containing(left: DataFrame, a: str, right: DataFrame, b: str, least: int) -> DataFrame:
    """All columns of the pairs of which one string holds the other; both have `least` characters or more.
    Strings that hold one another share the shorter one's first piece."""
    first = lambda df, c: df.withColumn("_piece", F.left(F.col(c), F.lit(least)))
    each = lambda df, c: df.withColumn("_piece", F.explode(pieces(F.col(c), least)))
    one = each(left, a).join(first(right, b), "_piece").where(F.contains(a, b))
    two = first(left, a).join(each(right, b), "_piece").where(F.contains(b, a) & (F.col(a) != F.col(b)))
    return one.unionByName(two).drop("_piece").distinct()

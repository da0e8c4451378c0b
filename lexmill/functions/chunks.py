"""Chunkers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraphs(text: Column) -> Column:
    """Parts between line breaks that have a character."""
    return F.filter(F.transform(F.split(text, "\n+"), lambda p: F.trim(p)), lambda p: p != "")


def packed(parts: Column, limit: int, overlap: int = 0) -> Column:
    """Parts joined by a line break up to `limit` characters; a chunk begins with the last `overlap`
    characters of the one before. A part that is longer stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc, p):
        fits = (acc["now"] == "") | (F.length(acc["now"]) + 1 + F.length(p) <= limit)
        grown = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n"), p))
        fresh = F.concat(F.right(acc["now"], F.lit(overlap)), F.lit("\n"), p) if overlap else p
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.when(fits, grown).otherwise(fresh).alias("now")
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def windows(text: Column, size: int, step: int) -> Column:
    """Substrings of `size` characters every `step`, the last one may be shorter; an empty text has none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

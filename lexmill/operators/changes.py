"""Change detection between snapshots; batch twins of the streaming state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, key: list[str], item: Column) -> DataFrame:
    """key, n, digest: an order-free digest of a key's distinct items, from partial sums of two
    32-bit parts of their hashes, so that no key's items are gathered."""
    h = F.md5(item.cast("string"))
    part = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(2)]
    d = rows.select(*key, h.alias("h"), *[p.alias(f"p{i}") for i, p in enumerate(part)]).distinct()
    return d.groupBy(*key).agg(F.count("*").alias("n"), F.concat_ws("-", F.sum("p0").cast("string"), F.sum("p1").cast("string")).alias("digest"))


def alerts(snapshots: DataFrame, key: list[str], at: str, state: str) -> DataFrame:
    """Rows whose state differs from the key's snapshot before; the first one is silent."""
    w = Window.partitionBy(*key).orderBy(at)
    return snapshots.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))

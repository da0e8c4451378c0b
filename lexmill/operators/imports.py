"""An import of several tables as one commit, and a catalogue that absorbs rows by their identity.

Each version of the tables is a folder of its own; a row of `commits`, written last, makes it the current one.
Readers go by the last commit, so a run that died leaves the old set, and the next run writes over its
remains. A fingerprint over all rows of all tables, whatever their order, is kept with the commit: an import of
the same rows writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_COMMIT = "version long, fingerprint string, name string, rows long"


def _fingerprint(df: DataFrame) -> tuple[int, str]:
    """rows, and a hash of them that does not depend on their order; repeated rows count."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    halves = [F.sum(F.pmod(F.xxhash64(row, F.lit(k)), F.lit(1 << 31)).cast("decimal(38,0)")) for k in range(4)]
    n, *sums = df.agg(F.count("*"), *halves).first()
    return n, ",".join([df.schema.simpleString(), str(n), *(str(s or 0) for s in sums)])


def commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], _COMMIT)


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """version and fingerprint of the last commit; 0 and none before the first."""
    last = commits(spark, path).orderBy(F.desc("version")).select("version", "fingerprint").first()
    return (last["version"], last["fingerprint"]) if last else (0, None)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last commit has it."""
    return spark.read.parquet(f"{path}/v{current(spark, path)[0]}/{name}")


def write_all(tables: dict[str, DataFrame], path: str) -> int:
    """Commits all tables and returns the version; the present one where the rows are the same."""
    spark = next(iter(tables.values())).sparkSession
    marks = {n: _fingerprint(df) for n, df in tables.items()}
    mark = ";".join(f"{n}:{m}" for n, (_, m) in sorted(marks.items()))
    version, before = current(spark, path)
    if mark == before:
        return version
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version + 1}/{name}")
    rows = [(version + 1, mark, n, count) for n, (count, _) in marks.items()]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version + 1


def absorb(base: DataFrame, incoming: DataFrame, identity: Column, place: str = "place") -> tuple[DataFrame, DataFrame]:
    """The base (key and fields) with the incoming rows (place and the fields) taken in, and the log: place, key,
    outcome. A row without an identity is skipped, as is one whose key came before in the batch; a known key
    only fills fields that are null or empty; other keys are inserted. A second load changes nothing."""
    names = [c for c in base.columns if c != "key"]
    rows = incoming.withColumn("key", identity)
    turn = F.row_number().over(Window.partitionBy("key").orderBy(place))
    keyed = rows.where("key IS NOT NULL").withColumn("turn", turn)
    first = keyed.where("turn = 1").select("key", place, *[F.col(c).alias(f"new {c}") for c in names])
    both = base.withColumn("known", F.lit(True)).join(first, "key", "full_outer")
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    filled = {c: F.when(blank(c) & ~blank(f"new {c}"), F.col(f"new {c}")).otherwise(F.col(c)) for c in names}
    fills = F.lit(False)
    for c in names:
        fills = fills | (blank(c) & ~blank(f"new {c}"))
    outcome = F.when(F.col("known").isNull(), "inserted").when(fills, "filled").otherwise("unchanged")
    log = both.where(F.col(place).isNotNull()).select(place, "key", outcome.alias("outcome"))
    log = log.unionByName(keyed.where("turn > 1").select(place, "key", F.lit("skipped: repeated in the batch").alias("outcome")))
    log = log.unionByName(rows.where("key IS NULL").select(place, "key", F.lit("skipped: no identity").alias("outcome")))
    return both.select("key", *[v.alias(c) for c, v in filled.items()]), log

"""File sources and sinks: JSON lines, CSV with an inferred header, tolerant scans, manifests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir); a local session
    without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: iterations start from files, not from the
    plan of all rounds before, and survive the loss of executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """One object for each line; null fields are left out."""
    rows.write.option("compression", compression).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that parse and have the required fields, and the lines that do not, with a reason."""
    kept = StructType(list(schema)).add("_corrupt", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("")) == "", F.lit(c)) for c in required]).cast("array<string>"))
    reason = F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "no JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    rows = parsed.withColumn("reason", reason)
    good = rows.where("reason is null").select(*[F.col("r").getField(c).alias(c) for c in schema.names])
    return good, rows.where("reason is not null").select("reason", "value")


def read_table_if_there(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A catalogue table's columns of the schema; no rows if there is no such table."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], schema)
    return spark.table(name).select(*schema.names)


def read_csv_matrix(spark: SparkSession, path: str, weights: dict[str, int], least: int = 5, look: int = 40) -> DataFrame:
    """One CSV file whose header is one of the first rows: the first row with the highest sum of weights
    of the names in it, row 0 if that is below `least`. Only these rows reach the driver; the header and
    the rows above it go by their place, equal rows below stay, blank rows go."""
    # the first split's rows are numbered from 0 in the file's order
    raw = spark.read.option("header", False).csv(path).withColumn("_place", F.monotonically_increasing_id())
    head = raw.where(F.col("_place") < look).orderBy("_place").drop("_place").collect()
    score = [sum(weights.get((c or "").strip().lower(), 0) for c in r) for r in head]
    best = score.index(max(score)) if score and max(score) >= least else 0
    names, seen = [], {}
    for i, c in enumerate(head[best] if head else []):
        name = (c or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    cells = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in raw.columns[:-1]])
    return raw.where((F.array_join(cells, "") != "") & (F.col("_place") > best)).drop("_place").toDF(*names)


def replace_source(rows: DataFrame, path: str, key: str) -> None:
    """All rows of the sources that appear are replaced; other sources' files stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, size, sha256 of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

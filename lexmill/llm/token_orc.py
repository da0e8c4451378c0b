"""Token ids as ORC files in ascending doc_id order.

Ids are integer lists, which ORC stores by run-length encoding (version 2) in stripes. Row indexes
and Bloom filters on doc_id let a reader skip stripes and row groups by metadata; readers split the
files by stripes. Each row also carries its part and its start within the part, so that the global
start of a document needs one sum for each part and no scan of the rows before it.

Files are ranges of (doc_id, XXH64 of the text), so that rows of one doc_id, or of none, are spread too.

Defined cases: a null text is empty and has the end id alone; equal doc_ids are ordered by that hash
(signed, seed 42) and text, a null doc_id comes first; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import library_memo
from .shared import fresh_dir, materialize, table, texts
from .units import id_lists, ids_of_lists, split_ids, with_end

END_ID = 0


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int = END_ID) -> None:
    """Encodes with the tokenizers library, appends end_id, writes ORC."""
    d = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at, part = library_memo(vocab_path), 0, TaskContext.get().partitionId()
        for b in batches:
            row = 0
            for flat, sizes in memo.slices(b.column(1)):
                flat, sizes = with_end(flat, sizes, end_id)
                starts = at + np.cumsum(sizes) - sizes
                at += len(flat)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(sizes)), pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), id_lists(flat, sizes)],
                    names=["doc_id", "part", "start_in_part", "ids"],
                )
                row += len(sizes)

    out = d.mapInArrow(run, f"doc_id {kind}, part int, start_in_part bigint, ids array<int>")
    (
        out.write.option("compression", "lz4")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The stored rows; with doc_ids only those, which the readers find by row index and Bloom filter."""
    d = spark.read.orc(path)
    return d if doc_ids is None else d.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    d = read(spark, path)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = ids_of_lists(b.column(3))
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3],
                    pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in split_ids(flat, sizes)], pa.int64()),
                ],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    rows = d.select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        run, f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    )
    rows = materialize(rows, "token-digests")
    # one row for each file: the window's single task sees as many rows as there are files
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_orc(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)

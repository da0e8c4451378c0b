"""The corpus pipeline: quality rules, near-duplicate removal, removal of repeated passages,
redaction of secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read back as the next one's docs. All but the last return the columns of
documents. Near duplicates are texts whose shingles of five words have a Jaccard similarity of 0.8 or
more, directly or through others; query op10 keeps its own contract (3-word shingles, 3 bits of 64).

Null texts count as empty and fail the rule of fewest words; of each near-duplicate group one row
stays, a null doc_id only where the group has no other; empty tables pass all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import best_fit, quality_rules, secret_scan, shingle_copies, suffix_dedup
from lexmill.llm.shared import materialize, table

POLICY = "v2"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the policy rejects go."""
    return quality_rules.keep(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The groups of near copies at the pipeline's own similarity: one row of each stays."""
    return shingle_copies.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of 50 bytes or more that a smaller doc_id has go from the texts."""
    return suffix_dedup.remove(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: secrets are replaced in the texts."""
    return secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents' tokens in sequences of several permitted lengths."""
    return best_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

#: SQL cannot express the packing; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A stored index of several fields, and BM25 over their weighted term counts.

A row of the index is a document with its distinct tokens, a count of each for every field, and its whole length, so
weights are chosen when a question is asked. As in the plain index, rows are counted and scored where they are read;
repeated ids, which must first be brought together, and more terms than a task may hold go by parts.
Letters lose their diacritics before words are cut.

Defined cases: null fields are empty; a row without words is in the index but never found; a question
without known terms has no rows; ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import postings, ranking

# Letters with diacritics and the ones they are compared as, place by place.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LEAST_IDF = 1e-6


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without diacritics, repeats included."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def _counted(fields: list[str]) -> Callable:
    """Of rows (part, id, and the words of each field) the distinct tokens and their counts in each field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, postings.ROWS_AT_ONCE):
                b = batch.slice(at, postings.ROWS_AT_ONCE)
                words = [b.column(2 + f) for f in range(len(fields))]
                sizes = [w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for w in words]
                token = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
                size = max(1, len(token.dictionary))
                doc = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
                key, at_key = np.unique(doc * size + token.indices.to_numpy(), return_inverse=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=b.num_rows)))), pa.int32())
                cuts = np.cumsum([0, *[n.sum() for n in sizes]])
                tfs = [np.bincount(at_key[lo:hi], minlength=len(key)) for lo, hi in zip(cuts, cuts[1:])]
                lists = [token.dictionary.take(pa.array(key % size)), *[pa.array(tf, pa.int32()) for tf in tfs]]
                cols = [b.column(0), b.column(1), pa.array(sum(sizes), pa.int32()), *[pa.ListArray.from_arrays(ends, x) for x in lists]]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "id", "dl", "tokens", *[f"tfs_{f}" for f in fields]])

    return run


def build(rows: DataFrame, fields: list[str], path: str) -> postings.Index:
    """Writes the index of rows (id and the fields)."""
    spark = rows.sparkSession
    # one row for each id; only ids are shuffled
    n, ids = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("id")).first()
    n = n or 0
    unique, parts = ids == n, max(8, -(-n // postings.DOCS_A_PART))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    cut = rows.select(part.alias("part"), "id", *[tokens(F.col(f)).alias(f) for f in fields])
    if unique:
        out = "".join(f", tfs_{f} array<int>" for f in fields)
        cut.mapInArrow(_counted(fields), f"part int, id {rows.schema['id'].dataType.simpleString()}, dl int, tokens array<string>{out}").write.parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        each, total = stored.select(F.explode("tokens").alias("token")), stored.agg(F.sum("dl")).first()[0] or 0
    else:
        cut = cut.withColumn("dl", sum((F.size(f) for f in fields), F.lit(0)))
        words = lambda f: F.transform(f, lambda t: F.struct(F.lit(f).alias("field"), t.alias("token")))
        each = cut.select("part", "id", "dl", F.inline(F.concat(*map(words, fields))))
        counts = each.groupBy("part", "id", "dl", "token").agg(*[F.count_if(F.col("field") == f).cast("int").alias(f"tf_{f}") for f in fields])
        counts.write.parquet(f"{path}/postings")
        each, total = spark.read.parquet(f"{path}/postings"), cut.agg(F.sum("dl")).first()[0] or 0
    each.groupBy("token").agg(F.count("*").alias("df")).write.parquet(f"{path}/tokens")
    return postings.Index(path, parts, n, total / n if n else 0.0, unique)


def _postings(spark: SparkSession, index: postings.Index) -> DataFrame:
    """part, id, dl, token and tf_<field>."""
    if not index.unique:
        return spark.read.parquet(f"{index.path}/postings")
    v = spark.read.parquet(f"{index.path}/vectors")
    tfs = [F.col(c).alias(c.replace("tfs_", "tf_", 1)) for c in v.columns if c.startswith("tfs_")]
    return v.select("part", "id", "dl", F.inline(F.arrays_zip(F.col("tokens").alias("token"), *tfs)))


def search(spark: SparkSession, index: postings.Index, questions: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """qid, id, score, matched, rank of the k best rows of questions (qid, body)."""
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("body")))).alias("token"))
    terms = postings.settle_terms(index.read(spark, "tokens").join(asked.select("token").distinct(), "token"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = asked.join(terms.select("token", "t"), "token").select("qid", "t", F.lit(1.0).alias("u"))
    k1, b = ranking.K1, ranking.B
    share = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / index.mean_length))
    said = postings.said_by(index, asked, terms, idf)
    if said is not None:
        zero = F.transform("tokens", lambda _: F.lit(0.0))
        tf = reduce(lambda x, f: F.zip_with(x, f"tfs_{f}", lambda a, n: a + weights[f] * n), weights, zero)
        rows = spark.read.parquet(f"{index.path}/vectors").select("id", "dl", F.lit(0.0).alias("norm"), "tokens", tf.alias("tfs"))
        return postings.first_of(postings.scored_in_place(rows, said, lambda tf, dl, norm: share(tf, dl), k, "score"), k, "score")
    tf = sum((w * F.col(f"tf_{f}") for f, w in weights.items()), F.lit(0.0))
    weighed = _postings(spark, index).join(terms, "token").select("part", "id", "t", (idf * share(tf, F.col("dl"))).alias("w"))
    return postings.best(index, weighed, asked, k, "score")

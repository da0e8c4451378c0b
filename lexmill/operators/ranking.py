"""Retrieval: inverted index, BM25, sparse and dense similarity, fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import in_place

K1, B = 1.2, 0.75
RRF_K = 60
QUERIES_A_TASK = 4_096  # queries that a task may hold; more go by parts
_CELLS = 2_000_000  # pairs scored at once


def term_rows(docs: DataFrame, id_col: str, body: Column) -> DataFrame:
    """id, token, tf, dl: the long form of the term-frequency vectors."""
    rows = docs.select(F.col(id_col).alias("id"), text.tokens(body).alias("ts"))
    return (
        rows.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("token")).groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    )


def postings(terms: DataFrame) -> DataFrame:
    """token, df, cf, max_tf: one row for each token."""
    return terms.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def query_terms(queries: DataFrame, id_col: str, body: Column) -> DataFrame:
    """qid, token: the distinct tokens of each query."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(text.tokens(body))).alias("token"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, bm25, matched of all pairs that share a token. docs: id, body; queries: qid, body.

    Document lengths and the collection's size are taken before only the queries' tokens are kept
    (a semi join), so the shuffle of term rows carries no token that nobody asks for.
    """
    asked = query_terms(queries, "qid", F.col("body"))
    split = docs.select("id", text.tokens(F.col("body")).alias("ts"))
    totals = split.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    each = split.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    rows = each.join(asked.select("token").distinct(), "token", "left_semi").groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = rows.join(df, "token").join(F.broadcast(totals)).select("id", "token", (idf * part).alias("w"))  # totals: one row
    return weighed.join(asked, "token").groupBy("qid", "id").agg(F.sum("w").alias("bm25"), F.count("*").alias("matched"))


def top(rows: DataFrame, by: str, k: int, key: str = "qid", tie: str = "id") -> DataFrame:
    """The k best rows of each key with their rank; ties by id."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def places(rows: DataFrame, key: list[str], by: str, tie: str, width: float) -> DataFrame:
    """The rows with rank, their place within the key by `by` descending, then `tie`. A key's rows are not
    sorted in one task: a row's place is its place within a band of `width` of the score, plus the rows of
    the bands above."""
    banded = rows.withColumn("_band", F.floor(F.col(by) / width))
    counts = banded.groupBy(*key, "_band").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_above", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*key, "_band").orderBy(F.desc(by), tie))
    return banded.withColumn("_place", inner).join(counts, [*key, "_band"]).withColumn("rank", F.col("_place") + F.col("_above")).drop("_band", "_place", "_above")


def sparse_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, cosine of term-frequency vectors; pairs without a common token are left out."""
    d = term_rows(docs, "id", F.col("body")).select("id", "token", F.col("tf").alias("d"))
    q = term_rows(queries.withColumnRenamed("qid", "id"), "id", F.col("body")).select(F.col("id").alias("qid"), "token", F.col("tf").alias("q"))
    dn = d.groupBy("id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("dn"))
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = d.join(q, "token").groupBy("qid", "id").agg(F.sum(F.col("d") * F.col("q")).alias("dot"))
    return dots.join(dn, "id").join(qn, "qid").select("qid", "id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine"))


def _dense(vectors: DataFrame, queries: DataFrame, k: int | None, block: int, rows_a_part: int) -> DataFrame:
    import pandas as pd

    q, vectors = queries.where("v is not null"), vectors.where("v is not null")
    blocks, n = max(1, -(-q.count() // block)), max(8, -(-vectors.count() // rows_a_part))  # blocks of queries, parts of rows
    part, turn = F.pmod(F.xxhash64("id"), F.lit(n)), F.pmod(F.xxhash64("qid"), F.lit(blocks))
    sent = vectors.select("id", "v", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = q.select("qid", F.col("v").alias("qv"), turn.cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))

    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, np.nan)

    def nearest(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"qid": [], "id": [], "cosine": []})
        ids, qids = rows["id"].to_numpy(), asks["qid"].to_numpy()
        sims = unit(np.stack(asks["qv"]).astype(float)) @ unit(np.stack(rows["v"]).astype(float)).T
        if k is None:
            near = np.tile(np.arange(len(ids)), (len(qids), 1))
        else:
            near = np.array([np.lexsort((ids, -s))[:k] for s in sims])
        return pd.DataFrame({"qid": np.repeat(qids, near.shape[1]), "id": ids[near].ravel(), "cosine": np.take_along_axis(sims, near, 1).ravel()}).dropna()

    return sent.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(nearest, "qid long, id long, cosine double")


def _unit(column) -> np.ndarray:
    """Vectors of a column of double lists, of length 1; those of no length are not numbers."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, np.nan)


def _told(vectors: DataFrame, queries: DataFrame):
    """The queries as qids and unit vectors for the tasks, and the rows; None if there are more than a task may hold."""
    v = F.col("v").cast("array<double>").alias("v")
    q = queries.where("v is not null").select("qid", v).orderBy("qid").limit(QUERIES_A_TASK + 1).toArrow().combine_chunks()
    if q.num_rows > QUERIES_A_TASK:
        return None
    unit = _unit(q.column("v").combine_chunks() if q.num_rows else [])
    rows = vectors.where("v is not null and id is not null").select("id", v)
    return q.column("qid").to_numpy(), rows.sparkSession.sparkContext.broadcast(unit), rows


def _cosines(unit: np.ndarray, batches) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, cosines of the queries (rows), and whether there is one, of a few vectors at once."""
    step = max(1, _CELLS // max(1, len(unit)))
    for b in batches:
        for at in range(0, b.num_rows if len(unit) else 0, step):
            some = b.slice(at, step)
            sims = np.round(unit @ _unit(some.column(1)).T, 9)
            yield some.column(0).to_numpy(), sims, ~np.isnan(sims)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256, rows_a_part: int = 20_000) -> DataFrame:
    """qid, id, cosine, rank: for each query the k nearest of all vectors (id, v).

    Queries reach the tasks as a table of checked size, and each task keeps its k best; vectors are not shuffled. More
    queries meet all rows in blocks: a row is sent once for each block of queries, never once for each query.
    """
    told = _told(vectors, queries)
    if told is None:
        return top(_dense(vectors, queries, k, block, rows_a_part).withColumn("cosine", F.round("cosine", 9)), "cosine", k)
    qids, sent, rows = told

    def run(batches):
        best = in_place.Best(len(qids), k)
        for ids, sims, there in _cosines(sent.value, batches):
            best.add(ids, sims, there)
        yield in_place.table(qids, best.i, best.ids, cosine=best.value)

    return top(rows.mapInArrow(run, "qid long, id long, cosine double"), "cosine", k)


def dense_places(vectors: DataFrame, queries: DataFrame, probes: DataFrame, block: int = 256, rows_a_part: int = 20_000) -> DataFrame:
    """qid, id, ahead for probes (qid, id, cosine): how many of all vectors (id, v) stand before it by cosine, then
    id. Each task counts its own rows; more queries than it may hold go by parts."""
    told = _told(vectors, queries)
    if told is None:
        return _dense_places(vectors, queries, probes, block, rows_a_part)
    qids, sent, rows = told

    def one(asked) -> DataFrame:
        probed = rows.sparkSession.sparkContext.broadcast(asked)

        def run(batches):
            i, wanted, _ = probed.value
            ahead = np.zeros(len(i), np.int64)
            for ids, sims, there in _cosines(sent.value, batches):
                ahead += in_place.ahead(ids, sims, there, probed.value)
            yield in_place.table(qids, i, wanted, ahead=ahead)

        return rows.mapInArrow(run, "qid long, id long, ahead long")

    counts = reduce(DataFrame.unionByName, map(one, in_place.turns(probes, qids, "cosine")))
    return counts.groupBy("qid", "id").agg(F.sum("ahead").alias("ahead"))


def _dense_places(vectors: DataFrame, queries: DataFrame, probes: DataFrame, block: int, rows_a_part: int) -> DataFrame:
    import pyarrow as pa

    q, vectors = queries.where("v is not null"), vectors.where("v is not null")
    blocks, n = max(1, -(-q.count() // block)), max(8, -(-vectors.count() // rows_a_part))
    turn = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("to_block")
    sent = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to_part")
    no = lambda kind: F.lit(None).cast(kind)
    asked = q.select("qid", F.col("v").cast("array<double>").alias("qv"), no("bigint").alias("probe"), no("double").alias("cosine"), turn, every)
    named = probes.select("qid", no("array<double>").alias("qv"), F.col("id").alias("probe"), "cosine", turn, every)

    def matrix(column) -> np.ndarray:
        m = np.array(column.to_pylist(), float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, np.nan)

    def count(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out, of = [], {}
        for qid, i, c in zip(*(asks.column(x).to_pylist() for x in ("qid", "probe", "cosine"))):
            if i is not None:
                of.setdefault(qid, []).append((i, c))
        is_vector = np.array([i is None for i in asks.column("probe").to_pylist()], bool)
        if rows.num_rows and of:
            ids, unit = rows.column("id").to_numpy(), matrix(rows.column("v"))
            asks = asks.filter(pa.array(is_vector))
            for qid, v in zip(asks.column("qid").to_pylist(), matrix(asks.column("qv")) if asks.num_rows else ()):
                if qid in of:
                    sims = np.round(unit @ v, 9)
                    there = ~np.isnan(sims)
                    order = np.lexsort((ids[there], -sims[there]))
                    mine, value = ids[there][order], -sims[there][order]
                    i, c = np.array([x for x, _ in of[qid]], np.int64), -np.array([x for _, x in of[qid]])
                    lo, hi = (np.searchsorted(value, c, side=s) for s in ("left", "right"))
                    ahead = lo + np.array([np.searchsorted(mine[a:b], x) for a, b, x in zip(lo, hi, i)], np.int64)
                    out.append((np.full(len(i), qid), i, ahead))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("qid", "id", "ahead"), cols)))

    counts = sent.groupBy("block", "part").cogroup(asked.unionByName(named).groupBy("to_block", "to_part")).applyInArrow(count, "qid long, id long, ahead long")
    return counts.groupBy("qid", "id").agg(F.sum("ahead").alias("ahead"))


def dense_all(vectors: DataFrame, queries: DataFrame, block: int = 256, rows_a_part: int = 2_000) -> DataFrame:
    """qid, id, cosine of a stated query set against all vectors, in blocks."""
    return _dense(vectors, queries, None, block, rows_a_part)


def fuse(left: DataFrame, right: DataFrame, weights: tuple[float, float] = (0.58, 0.42), k: int = RRF_K) -> DataFrame:
    """qid, id, score of two ranked lists (qid, id, rank) by reciprocal-rank fusion."""
    a = left.select("qid", "id", F.col("rank").alias("ra"))
    b = right.select("qid", "id", F.col("rank").alias("rb"))
    score = F.coalesce(weights[0] / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(weights[1] / (k + F.col("rb")), F.lit(0.0))
    return a.join(b, ["qid", "id"], "full_outer").select("qid", "id", "ra", "rb", score.alias("score"))


def facets(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: counts of several columns in one aggregation."""
    each = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in columns]
    return ranked.select(F.inline(F.array(*each))).groupBy("facet", "value").agg(F.count("*").alias("n"))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int, required: int = 3) -> DataFrame:
    """qid, hits, recall, mrr, ndcg, all_required, forbidden at k. ranked: qid, id, rank; gold: qid, id, grade:
    `required` or more must be there, 0 must not."""
    seen = ranked.where(F.col("rank") <= k).join(gold, ["qid", "id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col("rank") + 1)
    w = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "id")
    best = F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1))
    ideal = gold.withColumn("r", F.row_number().over(w)).groupBy("qid").agg(
        F.sum(best).alias("idcg"), F.count_if(F.col("grade") > 0).alias("wanted"), F.count_if(F.col("grade") >= required).alias("required")
    )
    got = seen.groupBy("qid").agg(
        F.count_if(F.col("g") > 0).alias("hits"), F.coalesce(1.0 / F.min(F.when(F.col("g") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"), F.sum(gain).alias("dcg"),
        F.count_if(F.col("g") >= required).alias("found"), F.count_if(F.col("grade") == 0).alias("forbidden"),
    )
    return got.join(ideal, "qid", "left").select(
        "qid", "hits", "mrr", F.coalesce(F.try_divide("hits", "wanted"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce((F.col("required") > 0) & (F.col("found") == F.col("required")), F.lit(False)).alias("all_required"), "forbidden",
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Hybrid search of many questions against all documents.

A question that cites documents ranks those alone, in joins over the cited pairs. The others rank all that
the tenant sees, from a stored index: a pair behind place REACH in both orders cannot score LEAST, so the
candidates are the first REACH by terms, the first REACH by vectors, and the pairs of which one names the
other. What a candidate lacks, its place in the other order, is counted by each task over its own rows; all pairs are never
formed, and no question's pairs are one task.

Neither texts nor their terms are shuffled: candidates and places come from the tasks that read the index and the vectors.

documents: id, record, citation, title, body, visibility, owner and further columns; vectors: id, v;
questions: qid, text, vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations, scores
from ..functions import text as T
from ..sources.files import settle
from . import filters, postings, ranking, rule_tables

NEAR, LEAST = 0.55, 8.0
REACH = 703  # 6100 / (RRF_K + REACH + 1) is below LEAST
PIECE = 8  # letters by which a name is looked up


def seen(docs: DataFrame, tenant: str) -> DataFrame:
    """The documents with a text that a tenant sees, with their normalised name."""
    rows = docs.where((F.coalesce("body", F.lit("")) != "") & filters.visible(F.col("visibility"), F.col("owner"), tenant))
    return rows.withColumn("name", T.normalise(F.concat_ws(" ", "title", "citation")))


def admitted(docs: DataFrame, tenant: str) -> DataFrame:
    return seen(docs, tenant).withColumn("ts", T.tokens(F.concat_ws(" ", "title", "citation", "body"))).drop("body")


def terms_of(questions: DataFrame) -> DataFrame:
    """Questions with at least one term: qid, asked (distinct terms), said (normalised), signals, vector."""
    q = questions.select("qid", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("asked"), T.normalise(F.coalesce("text", F.lit(""))).alias("said"), citations.signals(F.col("text")).alias("signals"), "vector")
    return q.where(F.size("asked") > 0)


def cited(docs: DataFrame, q: DataFrame) -> DataFrame:
    """qid, id of the documents whose citation or title carries a signal of the question."""
    has = docs.select("id", F.explode(citations.signals(F.concat_ws(" ", "citation", "title"))).alias("signal"))
    return q.select("qid", F.explode("signals").alias("signal")).join(has, "signal").select("qid", "id").distinct()


def pool_sizes(docs: DataFrame, q: DataFrame) -> DataFrame:
    """qid, pool, avgdl, restricted: the documents a question ranks and their mean length."""
    all_ = docs.agg(F.count("*").alias("all_n"), F.avg(F.size("ts")).alias("all_dl"))  # one row
    some = cited(docs, q).join(docs.select("id", F.size("ts").alias("dl")), "id").groupBy("qid").agg(F.count("*").alias("n"), F.avg("dl").alias("dl"))
    rows = q.select("qid").join(some, "qid", "left").join(F.broadcast(all_))
    return rows.select("qid", F.coalesce("n", "all_n").alias("pool"), F.coalesce("dl", "all_dl").alias("avgdl"), F.col("n").isNotNull().alias("restricted"))


def lexical(docs: DataFrame, q: DataFrame, sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, id, bm25, matched of the pairs of each question's pool that share a term."""
    asked = q.select("qid", F.explode("asked").alias("token"))
    each = docs.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    tf = each.join(asked.select("token").distinct(), "token", "left_semi").groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    m = asked.join(tf, "token").join(sizes, "qid").join(hits.withColumn("hit", F.lit(True)), ["qid", "id"], "left").where("hit OR NOT restricted")
    df = m.groupBy("qid", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("pool") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (ranking.K1 + 1) / (F.col("tf") + ranking.K1 * (1 - ranking.B + ranking.B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    return m.join(df, ["qid", "token"]).groupBy("qid", "id").agg(F.sum(idf * part).alias("bm25"), F.count("*").alias("matched"))


def corpus_index(spark, sf_dir: str, docs: DataFrame, tenant: str) -> postings.Index:
    """The session's stored index of what a tenant sees: title, citation and body together."""
    return postings.kept_index(spark, sf_dir, f"seen by {tenant}", seen(docs, tenant).select("id", F.concat_ws(" ", "title", "citation", "body").alias("body")))


def naming(docs: DataFrame, q: DataFrame, most: int = rule_tables.PHRASE_BYTES) -> DataFrame:
    """qid, id of the pairs of which the question names the document or its name holds the question. Questions of a
    checked size reach the documents' tasks, so names are neither gathered nor shuffled."""
    if (q.agg(F.sum(F.octet_length("said"))).first()[0] or 0) <= most:
        said = q.select("qid", "said").where("said <> ''").toArrow()  # of checked size
        names = docs.where("name <> ''").select("id", "name")
        one = names.mapInArrow(_named_by(docs.sparkSession.sparkContext.broadcast(said)), "qid long, id long")
    else:
        one = rule_tables.phrase_hits(q, "qid", "said", docs, "name").join(docs.select("id", F.col("name").alias("phrase")), "phrase").select("qid", "id")
    two = rule_tables.phrase_hits(docs, "id", "name", q, "said", most).join(q.select("qid", F.col("said").alias("phrase")), "phrase").select("qid", "id")
    return one.unionByName(two).distinct()


def _named_by(sent):
    """Of names (id, name) the questions sent (qid, said) that hold them. A name is looked for where its first letters occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, said = (c.to_pylist() for c in sent.value.columns)
        at = {}
        for i, text in enumerate(said):
            for size in range(1, PIECE + 1):
                for piece in {text[n : n + size] for n in range(len(text) - size + 1)}:
                    at.setdefault(piece, []).append(i)
        for b in batches:
            found = [(qids[i], k) for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in at.get(name[:PIECE], ()) if name in said[i]]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], names=["qid", "id"])

    return run


def _cosine():
    return F.round(scores.cosine(F.col("v"), F.col("vector")), 9)


def _open_pairs(docs: DataFrame, vectors: DataFrame, q: DataFrame, index: postings.Index, named: DataFrame) -> DataFrame:
    """qid, id, lex, rl, sem, rs of all candidates of the questions that cite nothing."""
    asks = q.where("vector IS NOT NULL").select("qid", F.col("vector").alias("v"))
    near = settle(ranking.dense_top(vectors, asks, REACH).select("qid", "id", F.col("cosine").alias("sem"), F.col("rank").alias("rs")), "dense")
    probes = settle(near.select("qid", "id").union(named.join(q.select("qid"), "qid", "left_semi")).distinct(), "probes")
    first, place = postings.grading(docs.sparkSession, index, q.select("qid", "asked"), docs.select("id"))
    graded = settle(first(probes, REACH), "graded")
    best = graded.where("NOT probed").withColumn("rl", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lex"), "id"))).where(F.col("rl") <= REACH)
    best = settle(best.select("qid", "id", "lex", F.col("rl").cast("long").alias("rl")), "lexical")
    lex = graded.where("probed").select("qid", "id", "lex").union(best.select("qid", "id", "lex")).distinct()
    pairs = probes.union(best.select("qid", "id")).distinct().join(lex, ["qid", "id"], "left").join(best.drop("lex"), ["qid", "id"], "left").join(near, ["qid", "id"], "left")
    pairs = pairs.withColumn("lex", F.coalesce("lex", F.lit(0.0))).join(vectors, "id", "left").join(q.select("qid", "vector"), "qid")
    pairs = settle(pairs.withColumn("sem", F.coalesce("sem", _cosine())).drop("v", "vector"), "candidates")
    lexical_ = place(pairs.where("rl IS NULL").select("qid", "id", "lex")).withColumnRenamed("place", "rl_behind")
    far = pairs.where("rs IS NULL AND sem IS NOT NULL").select("qid", "id", F.col("sem").alias("cosine"))
    dense = ranking.dense_places(vectors, asks, far).select("qid", "id", (F.col("ahead") + 1).alias("rs_behind"))
    pairs = pairs.join(lexical_, ["qid", "id"], "left").join(dense, ["qid", "id"], "left")
    return pairs.select("qid", "id", "lex", F.coalesce("rl", "rl_behind").alias("rl"), "sem", F.coalesce(F.col("rs").cast("long"), "rs_behind").alias("rs"))


def _cited_pairs(some: DataFrame, vectors: DataFrame, q: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same of all cited pairs: few documents (id, ts) for each question."""
    each = lexical(some, q, sizes, hits).join(q.select("qid", "asked"), "qid")
    lex = F.least(F.lit(1.0), F.col("bm25") / F.greatest(F.lit(2.0), 1.7 * F.size("asked"))) * 0.7 + 0.3 * F.col("matched") / F.size("asked")
    each = each.select("qid", "id", F.round(lex, 9).alias("lex"))
    pairs = hits.join(q.select("qid", "vector"), "qid").join(some.select("id"), "id").join(vectors, "id", "left").withColumn("sem", _cosine())
    pairs = pairs.select("qid", "id", "sem").join(each, ["qid", "id"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    pairs = ranking.places(settle(pairs, "cited-pairs"), ["qid"], "lex", "id", 0.02).withColumnRenamed("rank", "rl")
    by_sem = ranking.places(pairs.where("sem IS NOT NULL").select("qid", "id", "sem"), ["qid"], "sem", "id", 0.02).select("qid", "id", F.col("rank").alias("rs"))
    return pairs.join(by_sem, ["qid", "id"], "left").select("qid", "id", "lex", F.col("rl").cast("long").alias("rl"), "sem", F.col("rs").cast("long").alias("rs"))


def search(docs: DataFrame, vectors: DataFrame, questions: DataFrame, tenant: str, index: postings.Index) -> DataFrame:
    """qid, id, score, lex, sem, hit and the documents' further columns of all relevant pairs, one for each record. Texts are
    read where they are; of the documents only what stands beside the text is written and joined."""
    texts = seen(docs, tenant)
    docs = settle(texts.drop("body"), "search-documents")
    q = settle(terms_of(questions), "questions")
    hits = settle(cited(docs, q), "cited")
    some = texts.join(hits.select("id").distinct(), "id", "left_semi").select("id", T.tokens(F.concat_ws(" ", "title", "citation", "body")).alias("ts"))
    some = settle(some, "cited-documents")
    sizes = hits.join(some.select("id", F.size("ts").alias("dl")), "id").groupBy("qid").agg(F.count("*").alias("pool"), F.avg("dl").alias("avgdl")).withColumn("restricted", F.lit(True))
    asking = q.join(hits.select("qid").distinct(), "qid", "left_semi")
    open_ = settle(q.join(hits.select("qid").distinct(), "qid", "left_anti"), "open-questions")
    named = settle(naming(docs, q), "naming")
    vectors = settle(vectors.where("v IS NOT NULL").join(docs.select("id"), "id", "left_semi"), "search-vectors")
    pairs = _open_pairs(docs, vectors, open_, index, named).withColumn("hit", F.lit(False))
    pairs = pairs.unionByName(_cited_pairs(some, vectors, asking, hits, sizes).withColumn("hit", F.lit(True)))
    pairs = pairs.join(named.withColumn("exact", F.lit(True)), ["qid", "id"], "left").join(sizes.select("qid", "pool"), "qid", "left").withColumn("pool", F.coalesce("pool", F.lit(index.docs)))
    # a question is dense if any document of its pool has a vector beside its own
    dense = pairs.where("sem IS NOT NULL").select("qid").distinct().withColumn("dense", F.lit(True))
    pairs = pairs.join(dense, "qid", "left")
    both = 0.58 / (ranking.RRF_K + F.col("rl")) + 0.42 / (ranking.RRF_K + F.coalesce("rs", F.col("pool") + 1))
    score = F.least(F.lit(100.0), 6100 * F.when(F.col("dense"), both).otherwise(1.0 / (ranking.RRF_K + F.col("rl")))) * (0.45 + 0.55 * F.col("lex"))
    score = score * F.when(F.col("sem").isNull(), 1.0).otherwise(0.72 + 0.28 * F.greatest(F.lit(0.0), F.col("sem")))
    score = F.when(F.col("hit"), F.least(F.lit(100.0), score + 72)).when(F.col("exact"), F.least(F.lit(100.0), score + 18)).otherwise(score)
    rows = pairs.withColumn("score", F.round(score, 6)).where((F.col("score") >= LEAST) & ((F.col("lex") > 0) | (F.col("sem") >= NEAR)))
    rows = rows.join(docs.drop("title", "citation"), "id")
    w = Window.partitionBy("qid", "record").orderBy(F.desc("score"), "id")
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "name", "exact", "dense", "pool", "rl", "rs")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each question; every task keeps only its k best before they are gathered."""
    first = Window.partitionBy("qid", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("score"), "id")
    some = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    return ranking.top(some, "score", k)

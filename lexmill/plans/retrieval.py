"""Ranking queries: benchmark passages against all documents, vectors against vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import postings, ranking
from .base import query, spread, table
from .text_queries import _TOKENS

_BM25 = f"""d AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
b AS (SELECT item_id AS qid, {_TOKENS} AS ts FROM benchmark),
q AS (SELECT DISTINCT qid, unnest(ts) AS token FROM b),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w AS (SELECT id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM tf JOIN df USING (token), s),
bm AS (SELECT qid, id, sum(w) AS bm25, count(*) AS matched FROM w JOIN q USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, id) AS rank FROM bm)"""


def _inputs(spark, d):
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")))
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("body"))


def _index(spark, d):
    """The session's stored index of the documents."""
    return postings.index_of(spark, d, _inputs(spark, d)[0])


def build_index(spark, d):
    """Builds the stored index of the documents unless the session has it."""
    _index(spark, d)


def _ranked(spark, d, k, by="score"):
    """qid, id, bm25, matched, rank from the stored index."""
    return postings.bm25_top(spark, _index(spark, d), _inputs(spark, d)[1], k, by)


def _all_scored(spark, d):
    """qid, id, bm25, matched of all pairs that share a term, from the stored index."""
    return postings.bm25_all(spark, _index(spark, d), _inputs(spark, d)[1])


@query("r01_bm25_topk", f"WITH {_BM25} SELECT qid, id, round(bm25, 6) AS bm25, matched, rank FROM r WHERE rank <= 10")
def r01(spark, d):
    return _ranked(spark, d, 10).select("qid", "id", F.round("bm25", 6).alias("bm25"), "matched", F.col("rank").cast("long"))


@query("r02_hybrid_fusion", f"""WITH {_BM25},
f AS (SELECT qid, id, 0.58 / (60 + rank) + 0.42 / (60 + row_number() OVER (PARTITION BY qid ORDER BY matched DESC, id)) AS score FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f)
SELECT qid, id, round(score, 9) AS score, rank FROM t WHERE rank <= 10""")
def r02(spark, d):
    """Fusion of the complete lists: only the result is cut."""
    return _fused_full(_all_scored(spark, d).withColumn("bm25", F.round("bm25", 6))).select("qid", "id", "score", F.col("rank").cast("long"))


def _fused_full(scored):
    """The ten best of scored (qid, id, bm25, matched) by both ranks; every pair stands in both lists."""
    place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "id"))
    score = 0.58 / (ranking.RRF_K + place("bm25")) + 0.42 / (ranking.RRF_K + place("matched"))
    return ranking.top(scored.select("qid", "id", F.round(score, 9).alias("score")), "score", 10)


@query("r04_vector_topk", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q, v WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM p)
SELECT qid, id, round(cosine, 6) AS cosine, rank FROM t WHERE rank <= 10""")
def r04(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")
    return ranking.dense_top(v, q, 10).select("qid", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long"))


@query("r05_sparse_cosine", f"""WITH d AS (SELECT id, token, count(*) AS d FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
q AS (SELECT qid, token, count(*) AS q FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(d * d)) AS dn FROM d GROUP BY id), qn AS (SELECT qid, sqrt(sum(q * q)) AS qn FROM q GROUP BY qid),
p AS (SELECT qid, id, sum(d * q) AS dot FROM d JOIN q USING (token) GROUP BY ALL),
t AS (SELECT qid, id, round(dot / (dn * qn), 6) AS cosine FROM p JOIN dn USING (id) JOIN qn USING (qid))
SELECT qid, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM t) WHERE rank <= 10""")
def r05(spark, d):
    ranked = postings.cosine_top(spark, _index(spark, d), _inputs(spark, d)[1], 10)
    return ranked.select("qid", "id", F.round("score", 6).alias("cosine"), F.col("rank").cast("long"))


@query("r10_postings", f"""WITH t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL)
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM t GROUP BY token""")
def r10(spark, d):
    """The token table of the stored index; the posting lists lie beside it (r10_posting_lists)."""
    return _index(spark, d).read(spark, "tokens")


@query("r10_posting_lists", f"""WITH t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL)
SELECT token, doc_id AS id, tf FROM t""")
def r10_lists(spark, d):
    """All posting lists."""
    return _index(spark, d).read(spark, "postings").select("token", "id", "tf")


@query("r11_candidates", f"""WITH d AS (SELECT DISTINCT doc_id AS id, unnest({_TOKENS}) AS token FROM documents),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark),
c AS (SELECT qid, id, count(*) AS matched FROM d JOIN q USING (token) GROUP BY ALL)
SELECT qid, id, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, id) AS rank FROM c) WHERE rank <= 600""")
def r11(spark, d):
    """max(600, offset + 40 * limit) candidates at offset 0 and limit 10, by the number of matched terms."""
    return _ranked(spark, d, max(600, 0 + 40 * 10), "matched").select("qid", "id", "matched", F.col("rank").cast("long"))


@query("r12_hydrated", f"""WITH {_BM25}, c AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, id) AS m FROM bm) WHERE m <= 600)
SELECT qid, id, bm25, lang, source, rank FROM (SELECT qid, id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, id) AS rank FROM bm JOIN c USING (qid, id)) JOIN documents ON doc_id = id WHERE rank <= 10""")
def r12(spark, d):
    """Candidates by matched terms, ranked again and joined with their whole records."""
    c = _ranked(spark, d, 600, "matched").withColumn("bm25", F.round("bm25", 6)).drop("rank")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return ranking.top(c, "bm25", 10).join(docs, "id").select("qid", "id", "bm25", "lang", "source", F.col("rank").cast("long"))


@query("a12_facets", f"""WITH {_BM25}, h AS (SELECT d.* FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10)
SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, coalesce(lang, 'UNKNOWN') AS value FROM h UNION ALL SELECT 'source', coalesce(source, 'UNKNOWN') FROM h
 UNION ALL SELECT 'band', CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END FROM h) GROUP BY ALL""")
def a12(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return ranking.facets(_ranked(spark, d, 10).join(docs, "id").withColumn("band", band), ["lang", "source", "band"])


@query("m10_retrieval_metrics", f"""WITH {_BM25}, g AS (SELECT item_id AS qid, doc_id AS id, CASE WHEN quality = 1 THEN 3 WHEN toxic = 1 THEN 0 ELSE 1 END AS grade FROM benchmark JOIN labels ON doc_id % 50 = item_id % 50),
k AS (SELECT r.qid, r.id, rank, coalesce(grade, 0) AS g, g.id IS NULL AS unknown FROM r LEFT JOIN g ON g.qid = r.qid AND g.id = r.id WHERE rank <= 10),
i AS (SELECT qid, sum((pow(2, grade) - 1) / log2(n + 1)) FILTER (n <= 10) AS idcg, count(*) FILTER (grade > 0) AS wanted, count(*) FILTER (grade = 3) AS required FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS n FROM g) GROUP BY qid),
sc AS (SELECT qid, count(*) FILTER (g > 0) AS hits, count(*) FILTER (g = 3) AS found, coalesce(1.0 / min(CASE WHEN g > 0 THEN rank END), 0) AS mrr, sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (NOT unknown AND g = 0) AS forbidden FROM k GROUP BY qid)
SELECT qid, hits, round(mrr, 6) AS mrr, round(coalesce(hits / nullif(wanted, 0), 0), 6) AS recall, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, coalesce(required > 0 AND found = required, false) AS all_required, forbidden FROM sc LEFT JOIN i USING (qid)""")
def m10(spark, d):
    """Hits, reciprocal rank, recall, nDCG, whether every required document is there, and forbidden ones."""
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 50).alias("k"))
    grade = F.when(F.col("quality") == 1, 3).when(F.col("toxic") == 1, 0).otherwise(1)
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("k"), grade.alias("grade")).join(asks, "k").drop("k")
    m = ranking.retrieval_metrics(_ranked(spark, d, 10), gold, 10)
    return m.select("qid", "hits", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")], "all_required", "forbidden")


@query("u06_ranking_overlap", f"""WITH {_BM25},
c AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, id) AS rank FROM bm),
j AS (SELECT qid, id, r.rank AS a, c.rank AS b FROM (SELECT * FROM r WHERE rank <= 8) r FULL JOIN (SELECT * FROM c WHERE rank <= 8) c USING (qid, id))
SELECT qid, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (a = 1 AND b = 1) AS same_first FROM j GROUP BY qid""")
def u06(spark, d):
    a, b = (_ranked(spark, d, 8, c).select("qid", "id", F.col("rank").alias(n)) for c, n in (("score", "a"), ("matched", "b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, ["qid", "id"], "full_outer").groupBy("qid").agg(
        F.round(F.count_if(both) / F.count("*"), 6).alias("jaccard"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("same_first")
    )


@query("r32_context_budget", """WITH s AS (SELECT conv_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, count(*) AS taken, CAST(max(used) AS BIGINT) AS chars FROM s WHERE used <= 600 GROUP BY conv_id""")
def r32(spark, d):
    """Turns of a conversation in order until the next one would exceed the budget."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "conversations").select("conv_id", F.sum(F.length("text")).over(w).alias("used"))
    return s.where("used <= 600").groupBy("conv_id").agg(F.count("*").alias("taken"), F.max("used").alias("chars"))

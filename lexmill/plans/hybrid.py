"""The whole hybrid search: visibility, citation signals that restrict the pool, lexical and dense ranks fused,
exact matches, thresholds, one chunk for each record, facets over all relevant hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations
from ..operators import hybrid
from .base import query, spread, table
from .text_queries import _TOKENS

@query("r03_citation_signals", """WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS form, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT o_orderkey, CASE form WHEN 0 THEN 'pmk-' || (o_orderkey % 300) || '-' || y || ' uu-' || (o_orderkey % 40) || '-' || y
 WHEN 1 THEN 'kmk-' || (o_orderkey % 900) || '-' || y WHEN 2 THEN 'per-' || (o_orderkey % 50) || '-' || y ELSE '' END AS signals FROM k""")
def r03_signals(spark, d):
    """Type, number and year of every citation in a text; where the legacy order stands, it alone counts."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    n = lambda m: (k % m).cast("string")
    body = F.when(k % 4 == 0, F.concat(F.lit("see PMK Nomor "), n(300), F.lit(" Tahun "), y, F.lit(" and UU "), n(40), F.lit("/"), y))
    body = body.when(k % 4 == 1, F.concat(n(900), F.lit("/KMK.014/"), y)).when(k % 4 == 2, F.concat(F.lit("PER No. "), n(50), F.lit(" PJ 7 "), y))
    body = body.otherwise(F.concat(F.lit("Order "), k.cast("string"), F.lit(" of "), y))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(citations.signals(body), " ").alias("signals"))


def corpus(spark, d):
    """Documents as search records: a chunk's citation and title, its record's key, visibility, dates."""
    docs = spread(table(spark, d, "documents")).where("coalesce(text, '') <> ''")
    year = (1990 + F.col("doc_id") % 30).cast("string")
    return docs.select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("record"), F.concat(F.lit("PMK "), F.col("doc_id").cast("string"), F.lit("/"), year).alias("citation"),
        F.left("text", F.lit(40)).alias("title"), F.col("text").alias("body"), F.when(F.col("lang") != "es", "public").otherwise("tenant").alias("visibility"),
        F.col("source").alias("owner"), "lang", "source", "n_chars",
    )


def questions(spark, d):
    """Benchmark passages; every tenth asks for a document by its citation instead."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("qid") % 200
    cited = F.concat(F.lit("PMK Nomor "), k.cast("string"), F.lit(" Tahun "), (1990 + k % 30).cast("string"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return b.select("qid", F.when(F.col("qid") % 10 == 0, cited).otherwise(F.col("text")).alias("text")).join(v, "qid", "left")


_N = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_Q = "CASE WHEN item_id % 10 = 0 THEN 'PMK Nomor ' || (item_id % 200) || ' Tahun ' || (1990 + item_id % 200 % 30) ELSE coalesce(text, '') END"
_DOC_TOKENS = _TOKENS.replace("coalesce(text, '')", "title || ' ' || citation || ' ' || body")
_SEARCH = f"""c0 AS MATERIALIZED (SELECT doc_id AS id, doc_id // 4 AS record, 'PMK ' || doc_id || '/' || (1990 + doc_id % 30) AS citation, left(text, 40) AS title, text AS body, lang, source, n_chars FROM documents
 WHERE coalesce(text, '') <> '' AND (coalesce(lang <> 'es', false) OR coalesce(source = 'src1', false))),
c AS MATERIALIZED (SELECT id, record, {_N("title || ' ' || citation")} AS name, lang, source, n_chars FROM c0), w AS MATERIALIZED (SELECT id, unnest({_DOC_TOKENS}) AS token FROM c0),
tf AS MATERIALIZED (SELECT id, token, count(*) AS tf FROM w GROUP BY ALL), dl AS MATERIALIZED (SELECT c.id, count(token) AS dl FROM c LEFT JOIN w USING (id) GROUP BY c.id),
qs AS (SELECT item_id AS qid, {_Q} AS text FROM benchmark), qt AS MATERIALIZED (SELECT qid, {_N("text")} AS said, list_distinct({_TOKENS}) AS ts FROM qs WHERE len({_TOKENS}) > 0),
cited AS MATERIALIZED (SELECT qid, id FROM qt JOIN c ON qid % 10 = 0 AND id = qid % 200), pool AS MATERIALIZED (SELECT qid, id, true AS hit FROM cited UNION ALL SELECT qid, id, false FROM qt, c WHERE qid NOT IN (SELECT qid FROM cited)),
q AS MATERIALIZED (SELECT qid, unnest(ts) AS token FROM qt), st AS MATERIALIZED (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM pool JOIN dl USING (id) GROUP BY qid),
m AS MATERIALIZED (SELECT qid, id, token, tf FROM q JOIN tf USING (token) JOIN pool USING (qid, id)), df AS MATERIALIZED (SELECT qid, token, count(*) AS df FROM m GROUP BY ALL),
l AS MATERIALIZED (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1, avgdl))))) AS bm25, count(*) AS matched FROM m JOIN df USING (qid, token) JOIN st USING (qid) JOIN dl USING (id) GROUP BY ALL),
e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), se AS MATERIALIZED (SELECT qid, id, list_cosine_similarity(a.e, b.e) AS sem FROM pool JOIN e a ON a.vec_id = qid JOIN e b ON b.vec_id = id),
p AS MATERIALIZED (SELECT qid, id, hit, round(coalesce(least(1, bm25 / greatest(2, 1.7 * len(qt.ts))) * 0.7 + 0.3 * matched / len(qt.ts), 0), 9) AS lex, round(sem, 9) AS sem, contains(name, said) OR contains(said, name) AS near
 FROM pool JOIN qt USING (qid) JOIN c USING (id) LEFT JOIN l USING (qid, id) LEFT JOIN se USING (qid, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, id) AS rl, row_number() OVER (PARTITION BY qid ORDER BY sem DESC NULLS LAST, id) AS rs, count(*) OVER (PARTITION BY qid) AS n, count(sem) OVER (PARTITION BY qid) AS ns FROM p),
s AS (SELECT *, least(100, 6100 * CASE WHEN ns > 0 THEN 0.58 / (60 + rl) + 0.42 / (60 + CASE WHEN sem IS NULL THEN n + 1 ELSE rs END) ELSE 1.0 / (60 + rl) END) * (0.45 + 0.55 * lex) * CASE WHEN sem IS NULL THEN 1 ELSE 0.72 + 0.28 * greatest(0, sem) END AS base FROM r),
f AS (SELECT *, round(CASE WHEN hit THEN least(100, base + 72) WHEN near THEN least(100, base + 18) ELSE base END, 6) AS score FROM s WHERE lex > 0 OR sem >= 0.55),
k AS (SELECT f.*, record, lang, source, n_chars, row_number() OVER (PARTITION BY qid, record ORDER BY score DESC, f.id) AS place FROM f JOIN c USING (id) WHERE score >= 8), relevant AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k WHERE place = 1)"""


def _search(spark, d):
    docs, vectors = corpus(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return hybrid.search(docs, vectors, questions(spark, d), "src1", hybrid.corpus_index(spark, d, docs, "src1"))


@query("r01_hybrid_search", f"WITH {_SEARCH} SELECT qid, id, score, round(lex, 4) AS lexical, round(sem, 4) AS semantic, hit AS cited, rank FROM relevant WHERE rank <= 10")
def r01_hybrid(spark, d):
    s = _search(spark, d)
    top = hybrid.best(s, 10)
    return top.select("qid", "id", "score", F.round("lex", 4).alias("lexical"), F.round("sem", 4).alias("semantic"), F.col("hit").alias("cited"), F.col("rank").cast("long"))


@query("r02_citation_pool", f"WITH {_SEARCH} SELECT qid, count(*) AS pool, bool_or(hit) AS restricted FROM pool GROUP BY qid")
def r02_pool(spark, d):
    """How many documents each question ranks: those it cites, or all that the tenant sees."""
    c, q = hybrid.admitted(corpus(spark, d), "src1"), hybrid.terms_of(questions(spark, d))
    return hybrid.pool_sizes(c, q).select("qid", "pool", "restricted")


@query("a12_facets_of_relevant", f"""WITH {_SEARCH}, x AS (SELECT qid, unnest(['lang', 'source', 'band']) AS facet, unnest([coalesce(lang, 'unknown'), coalesce(source, 'unknown'), CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END]) AS value FROM relevant)
SELECT qid, facet, value, count(*) AS n FROM x GROUP BY ALL""")
def a12_relevant(spark, d):
    """Facets over every relevant hit of a question, before any limit or facet filter."""
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    rows = _search(spark, d)
    each = [F.struct(F.lit(n).alias("facet"), F.coalesce(c, F.lit("unknown")).alias("value")) for n, c in (("lang", F.col("lang")), ("source", F.col("source")), ("band", band))]
    return rows.select("qid", F.inline(F.array(*each))).groupBy("qid", "facet", "value").agg(F.count("*").alias("n"))

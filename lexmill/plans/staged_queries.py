"""The staged retriever over the documents: a record is four documents, its units are their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings, staged
from ..sources.files import settle
from .base import query, spread, table
from .retrieval import _BM25, _index
from .text_queries import _TOKENS

_TITLE = _TOKENS.replace("coalesce(text, '')", "left(coalesce(text, ''), 80)")


def _stages(spark, d):
    docs = spread(table(spark, d, "documents"))
    labels = table(spark, d, "labels")
    record = F.floor(F.col("doc_id") / 4)
    own = (F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) * 6.0 - F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)) * 8.0)
    head = F.min_by(F.left(F.coalesce("text", F.lit("")), F.lit(80)), "doc_id")
    records = docs.join(labels, "doc_id", "left").groupBy(record.alias("record")).agg(own.alias("own"), head.alias("head"))
    n = F.col("record")
    kind = F.when(n % 3 == 0, "uu").when(n % 3 == 1, "pp").otherwise("pmk")
    records = settle(records.select("record", (F.col("own") + n % 7 * 0.4).alias("own"), kind.alias("kind"), (n % 5 * 4.0).alias("bonus"), T.tokens(F.col("head")).alias("title")), "records")
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("body"))
    own_terms = asked.select("qid", F.explode(F.array_distinct(T.tokens(F.col("body")))).alias("token"))
    # the expansion table: a token of a record's title adds the next one
    t = records.where("record % 10 = 0").select(F.explode(F.arrays_zip(F.col("title").alias("a"), F.slice("title", F.lit(2), F.lit(80)).alias("b"))).alias("p"))
    terms = settle(staged.expanded(own_terms, t.select(F.col("p.a").alias("token"), F.col("p.b").alias("added")).where("added IS NOT NULL").distinct()), "terms")
    index = _index(spark, d)
    questions = terms.groupBy("qid").agg(F.array_join(F.collect_list("token"), " ").alias("body"))
    scored = postings.bm25_top(spark, index, questions, staged.UNITS).select("qid", "id", "bm25", F.floor(F.col("id") / 4).alias("record"))
    held = index.read(spark, "postings").select("id", "token").join(terms, "token")
    hits = settle(scored.join(held, ["qid", "id"]), "unit-terms")
    pinned = asked.where("qid % 40 = 0").select("qid", F.explode(F.sequence(F.col("qid") % 97, F.lit(2_000).cast("long"), F.lit(970).cast("long"))).alias("record"))
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag", "l_discount")
    both = lambda x: x.select("a", "b").union(x.select("b", "a").toDF("a", "b"))
    slots = asked.where("qid % 60 = 0").select("qid", F.inline(F.array(F.struct(F.lit("uu").alias("kind"), F.lit(1).alias("quota")), F.struct(F.lit("pmk").alias("kind"), F.lit(2).alias("quota")))))
    return terms, hits, pinned, records, both(e.where("l_discount >= 0.09")), slots, both(e.where("l_discount >= 0.09 AND l_returnflag = 'A'"))


_RECORDS = f"""rec AS MATERIALIZED (SELECT record, own + record % 7 * 0.4 AS own, CASE record % 3 WHEN 0 THEN 'uu' WHEN 1 THEN 'pp' ELSE 'pmk' END AS kind, record % 5 * 4.0 AS bonus, title FROM
 (SELECT d.doc_id // 4 AS record, coalesce(max((quality = 1)::INT), 0) * 6.0 - coalesce(max((toxic = 1)::INT), 0) * 8.0 AS own, arg_min({_TITLE}, d.doc_id) AS title FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)),
x AS (SELECT DISTINCT title[i] AS token, title[i + 1] AS added FROM (SELECT title, unnest(range(1, len(title))) AS i FROM rec WHERE record % 10 = 0)),
q0 AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark WHERE item_id % 20 = 0), terms AS MATERIALIZED (SELECT qid, token FROM q0 UNION SELECT qid, added FROM q0 JOIN x USING (token)), n AS (SELECT qid, count(*) AS n FROM terms GROUP BY 1)"""
_STAGED = _BM25[: _BM25.index(",\nbm AS")].replace("q AS (SELECT DISTINCT qid", "q_ AS (SELECT DISTINCT qid") + f""", {_RECORDS},
u AS MATERIALIZED (SELECT qid, id, sum(w) AS bm25 FROM w JOIN terms USING (token) GROUP BY ALL), k AS MATERIALIZED (SELECT *, id // 4 AS record, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, id) - 1 AS place FROM u QUALIFY place < 6000),
bu AS (SELECT qid, record, min(place) AS place, arg_min(bm25, place) AS bm25 FROM k GROUP BY ALL), c AS (SELECT qid, record, count(DISTINCT token) AS covered FROM k JOIN tf USING (id) JOIN terms USING (qid, token) GROUP BY ALL),
t AS MATERIALIZED (SELECT qid, record, count(*) AS overlap FROM terms JOIN (SELECT record, unnest(list_distinct(title)) AS token FROM rec) USING (token) GROUP BY ALL),
one AS MATERIALIZED (SELECT bu.qid, bu.record, bm25 + 8.0 * coalesce(overlap, 0) + 32.0 * covered / n.n + own - 0.002 * place AS score FROM bu JOIN c USING (qid, record) LEFT JOIN t USING (qid, record) JOIN n ON n.qid = bu.qid JOIN rec ON rec.record = bu.record),
a0 AS (SELECT t.qid, t.record, 18.0 * overlap + 48.0 * overlap / n.n AS s FROM t JOIN n USING (qid) WHERE (t.qid, t.record) NOT IN (SELECT (qid, record) FROM bu) QUALIFY row_number() OVER (PARTITION BY t.qid ORDER BY round(s, 6) DESC, t.record) <= 400),
pin AS (SELECT item_id AS qid, unnest(range(item_id % 97, 2001, 970)) AS record FROM benchmark WHERE item_id % 40 = 0),
found AS (SELECT qid, record, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT qid, record, s + own - 12.0 FROM a0 JOIN rec USING (record) UNION ALL SELECT qid, record, 10000.0 FROM pin JOIN rec USING (record)) GROUP BY ALL),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, record) AS rank FROM found QUALIFY rank <= 80),
e0 AS (SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS fl FROM lineitem WHERE l_discount >= 0.09), e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0) JOIN rec ON rec.record = b),
st AS (SELECT a, b FROM e0 WHERE fl = 'A' UNION SELECT b, a FROM e0 WHERE fl = 'A'),
h1 AS MATERIALIZED (SELECT qid, b AS record, max(score) * 0.62 AS score FROM f JOIN e ON a = f.record WHERE rank <= 30 AND (qid, b) NOT IN (SELECT (qid, record) FROM f WHERE rank <= 30) GROUP BY ALL),
h2 AS MATERIALIZED (SELECT qid, b AS record, max(score) * 0.42 AS score FROM h1 JOIN e ON a = h1.record WHERE (qid, b) NOT IN (SELECT (qid, record) FROM f WHERE rank <= 30) AND (qid, b) NOT IN (SELECT (qid, record) FROM h1) GROUP BY ALL),
h AS (SELECT qid, record, score, 1 AS hop FROM h1 UNION ALL SELECT qid, record, score, 2 FROM h2),
al AS MATERIALIZED (SELECT qid, record, score, 0 AS hop FROM f WHERE (qid, record) NOT IN (SELECT (qid, record) FROM h) UNION ALL SELECT * FROM h)"""


@query("r27_staged_retrieval", f"""WITH {_STAGED}, lk AS (SELECT DISTINCT qid, a AS record FROM st JOIN (SELECT qid, record FROM al JOIN f USING (qid, record) WHERE rank <= 20) z ON z.record = st.b),
g AS (SELECT al.*, kind, row_number() OVER (PARTITION BY al.qid ORDER BY round(al.score, 6) DESC, al.record) AS rank, al.qid % 60 = 0 AS slotted,
 al.score + CASE WHEN al.qid % 60 = 0 THEN bonus + CASE WHEN lk.qid IS NOT NULL THEN 28.0 ELSE 0 END ELSE 0 END AS total FROM al JOIN rec ON rec.record = al.record LEFT JOIN lk ON lk.qid = al.qid AND lk.record = al.record),
r0 AS (SELECT *, slotted AND row_number() OVER (PARTITION BY qid, kind ORDER BY round(total, 6) DESC, record) <= CASE kind WHEN 'uu' THEN 1 WHEN 'pmk' THEN 2 ELSE 0 END AS reserved FROM g),
r1 AS (SELECT *, 10 - count(*) FILTER (reserved) OVER (PARTITION BY qid) AS remaining FROM r0), r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 6) DESC, record) AS place FROM r1 WHERE reserved OR rank <= remaining)
SELECT qid, record, round(score, 6) AS score, hop, CAST(place AS INT) AS place FROM r2 WHERE place <= 10""")
def r27(spark, d):
    """All stages: expansion, units, titles, pins, two hops, reserved places."""
    terms, hits, pinned, records, edges, slots, structural = _stages(spark, d)
    found = settle(staged.direct(staged.best_units(hits, terms), staged.titles(terms, records), terms, pinned, records), "direct")
    rows = settle(staged.along_edges(found, edges, records), "reached")
    return staged.selected(rows, records, slots, structural, 10)

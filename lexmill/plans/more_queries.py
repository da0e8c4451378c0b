"""Further operators: hybrid scoring, chunking, sources, roll-ups, queues, selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks, scores
from ..functions import text as T
from ..operators import graphs, merging, quality, ranking
from ..sources import files
from .base import query, table
from .retrieval import _BM25, _all_scored, _inputs, _ranked
from .text_queries import _TOKENS


@query("r03_hybrid_score", f"""WITH {_BM25}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT qid, id, bm25, least(1, bm25 / greatest(2, 1.7 * nq)) * 0.7 + 0.3 * matched / nq AS lex, list_cosine_similarity(a.e, b.e) AS sem
 FROM bm JOIN nq USING (qid) JOIN documents d ON d.doc_id = bm.id LEFT JOIN v a ON a.vec_id = qid LEFT JOIN v b ON b.vec_id = id
 WHERE d.source LIKE '%0' OR d.source LIKE '%2' OR d.source LIKE '%4' OR d.source LIKE '%6' OR d.source LIKE '%8' OR d.source = 'src1'),
l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, id) AS rl, count(*) OVER (PARTITION BY qid) AS n,
 row_number() OVER (PARTITION BY qid ORDER BY round(sem, 6) DESC NULLS LAST, id) AS rs FROM p),
sc AS (SELECT qid, id, least(100, 6100 * (0.58 / (60 + rl) + 0.42 / (60 + CASE WHEN sem IS NULL THEN n + 1 ELSE rs END))) * (0.45 + 0.55 * lex) * (0.72 + 0.28 * greatest(0, coalesce(sem, 0))) AS score FROM l)
SELECT qid, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, id) AS rank FROM sc) WHERE rank <= 10""")
def r03(spark, d):
    """Rows that the tenant may see; lexical and dense ranks fused, then weighed by both scores."""
    asks = _inputs(spark, d)[1]
    seen = table(spark, d, "documents").where(F.col("source").rlike("[02468]$") | (F.col("source") == "src1")).select(F.col("doc_id").alias("id"))
    nq = ranking.query_terms(asks, "qid", F.col("body")).groupBy("qid").agg(F.count("*").alias("nq"))
    v = table(spark, d, "embeddings")
    p = _all_scored(spark, d).join(nq, "qid").join(seen, "id", "left_semi")
    p = p.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a")), "qid", "left").join(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b")), "id", "left")
    lex = F.least(F.lit(1.0), F.col("bm25") / F.greatest(F.lit(2.0), 1.7 * F.col("nq"))) * 0.7 + 0.3 * F.col("matched") / F.col("nq")
    p = p.select("qid", "id", lex.alias("lex"), scores.cosine(F.col("a"), F.col("b")).alias("sem"))
    w = Window.partitionBy("qid")
    rl = F.row_number().over(w.orderBy(F.round("lex", 6).desc(), "id"))
    rs = F.when(F.col("sem").isNull(), F.count("*").over(w) + 1).otherwise(F.row_number().over(w.orderBy(F.round("sem", 6).desc_nulls_last(), "id")))
    fused = F.least(F.lit(100.0), 6100 * (0.58 / (ranking.RRF_K + F.col("rl")) + 0.42 / (ranking.RRF_K + F.col("rs"))))
    s = p.withColumn("rl", rl).withColumn("rs", rs).withColumn("score", F.round(fused * (0.45 + 0.55 * F.col("lex")) * (0.72 + 0.28 * F.greatest(F.lit(0.0), F.coalesce("sem", F.lit(0.0)))), 4))
    return ranking.top(s, "score", 10).select("qid", "id", "score", F.col("rank").cast("long"))


@query("r16_fielded_terms", f"""WITH b AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), t AS (SELECT doc_id, unnest({_TOKENS.replace("coalesce(text, '')", "left(coalesce(text, ''), 60)")}) AS token FROM documents),
w AS (SELECT doc_id, token, count(*) AS tf FROM b GROUP BY ALL UNION ALL SELECT doc_id, token, 3 * count(*) FROM t GROUP BY ALL)
SELECT doc_id, CAST(sum(tf) AS BIGINT) AS weight, count(DISTINCT token) AS tokens FROM w GROUP BY doc_id""")
def r16(spark, d):
    """Weighted term frequencies of two fields: the text once, its first 60 characters three times more."""
    text = F.coalesce("text", F.lit(""))
    fields = F.array(F.struct(F.lit(1).alias("w"), T.tokens(text).alias("ts")), F.struct(F.lit(3).alias("w"), T.tokens(F.left(text, F.lit(60))).alias("ts")))
    rows = table(spark, d, "documents").select("doc_id", F.inline(fields)).select("doc_id", "w", F.explode("ts").alias("token"))
    g = rows.groupBy("doc_id", "token").agg(F.sum("w").alias("tf"))
    return g.groupBy("doc_id").agg(F.sum("tf").alias("weight"), F.count("*").alias("tokens"))


@query("r17_status_weights", f"""WITH {_BM25}
SELECT qid, id, round(bm25 * CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.0 ELSE 0.8 END * (1 + least(n_chars, 4500) / 30000.0), 4) AS score FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 20""")
def r17(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    bonus = F.coalesce(F.create_map(*[F.lit(x) for x in ("en", 1.2, "de", 1.0)])[F.col("lang")], F.lit(0.8))
    best = _ranked(spark, d, 20)
    return best.join(docs, "id").select("qid", "id", F.round(F.col("bm25") * bonus * (1 + F.least("n_chars", F.lit(4500)) / 30000), 4).alias("score"))


@query("r36_source_tiers", "SELECT page_id, CASE WHEN host LIKE '%.org' OR host LIKE '%.gov' THEN 'first' WHEN host LIKE '%.com' THEN 'second' ELSE 'third' END AS tier FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages)")
def r36(spark, d):
    h = T.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.when(h.rlike(r"\.(org|gov)$"), "first").when(h.endswith(".com"), "second").otherwise("third").alias("tier"))


@query("x01_paragraph_chunks")
def x01(spark, d):
    """Line-based chunks of up to 1800 characters with 180 characters of overlap; no SQL twin
    (a running state), tested against a plain loop."""
    c = chunks.packed(chunks.paragraphs(F.coalesce("text", F.lit(""))), 1800, 180)
    return table(spark, d, "documents").select("doc_id", F.posexplode(c).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("x02_window_chunks", """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(1, length(t)), 2040)) AS s FROM t WHERE t <> '')
SELECT doc_id, s // 2040 AS chunk_no, md5(substring(t, s + 1, 2200)) AS chunk_md5 FROM s""")
def x02(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunks.windows(F.coalesce("text", F.lit("")), 2200, 2040)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long"), F.md5("chunk").alias("chunk_md5"))


@query("x33_outcome_tail", """SELECT doc_id, CASE WHEN tail LIKE '%token%' THEN 'secret' WHEN tail LIKE '%!!%' THEN 'loud' WHEN low LIKE '%token%' THEN 'secret before' WHEN low LIKE '%!!%' THEN 'loud before' ELSE 'plain' END AS outcome
FROM (SELECT doc_id, low, right(low, 35000) AS tail FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))""")
def x33(spark, d):
    """Ordered tests on the last 35,000 characters, then the same tests on the whole text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    tail = F.right(low, F.lit(35000))
    label = F.when(tail.contains("token"), "secret").when(tail.contains("!!"), "loud").when(low.contains("token"), "secret before").when(low.contains("!!"), "loud before")
    return table(spark, d, "documents").select("doc_id", label.otherwise("plain").alias("outcome"))


@query("p30_json_values", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p30(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f11_domain_gate", """SELECT doc_id, score, score >= 30 AS in_scope FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '(token|password|secret)') THEN 35 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]{4}') THEN 8 ELSE 0 END - CASE WHEN contains(coalesce(text, ''), '!!') THEN 35 ELSE 0 END AS score FROM documents)""")
def f11(spark, d):
    t = F.coalesce("text", F.lit(""))
    score = F.when(F.lower(t).rlike("(token|password|secret)"), 35).otherwise(0) + F.when(t.rlike("[0-9]{4}"), 8).otherwise(0) - F.when(t.contains("!!"), 35).otherwise(0)
    return table(spark, d, "documents").select("doc_id", score.alias("score")).withColumn("in_scope", F.col("score") >= 30)


@query("a26_best_with_evidence", """SELECT l_partkey, arg_max(l_suppkey, (l_extendedprice, l_orderkey, l_linenumber)) AS best, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags FROM lineitem GROUP BY 1""")
def a26(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.max_by("l_suppkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("best"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags")
    )


@query("a27_best_and_top_three", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, max(o_totalprice) AS best, string_agg(o_orderkey, ',' ORDER BY n) AS top FROM r WHERE n <= 3 GROUP BY 1""")
def a27(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    r = table(spark, d, "orders").withColumn("n", n).where("n <= 3")
    top = F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return r.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.array_join(top, ",").alias("top"))


@query("a16_coverage", "SELECT round(100.0 * count(*) FILTER (coalesce(text, '') <> '') / count(*), 2) AS text_pct, round(100.0 * count(*) FILTER (lang IS NOT NULL) / count(*), 2) AS lang_pct FROM documents")
def a16(spark, d):
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    return table(spark, d, "documents").agg(pct(F.coalesce("text", F.lit("")) != "").alias("text_pct"), pct(F.col("lang").isNotNull()).alias("lang_pct"))


@query("a33_weighted_completeness", "SELECT doc_id, round((CASE WHEN coalesce(text, '') <> '' THEN 5 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 2 ELSE 0 END) / 10.0, 3) AS completeness FROM documents")
def a33(spark, d):
    parts = ((F.coalesce("text", F.lit("")) != "", 5), (F.col("lang").isNotNull(), 3), (F.col("source").isNotNull(), 2))
    return table(spark, d, "documents").select("doc_id", F.round(sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0)) / 10, 3).alias("completeness"))


@query("w18_number_then_suffix_order", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(nullif(regexp_extract(p_type, '([0-9]+)', 1), '') AS INT) NULLS FIRST, p_type, p_partkey) AS place FROM part""")
def w18(spark, d):
    n = F.nullif(F.regexp_extract("p_type", "([0-9]+)", 1), F.lit("")).try_cast("int")
    w = Window.partitionBy("p_brand").orderBy(n.asc_nulls_first(), "p_type", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("w21_review_priority", """SELECT l_orderkey, CAST(sum(CASE l_returnflag WHEN 'R' THEN 100 WHEN 'A' THEN 10 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 5 ELSE 0 END) AS BIGINT) AS priority FROM lineitem GROUP BY 1""")
def w21(spark, d):
    p = F.when(F.col("l_returnflag") == "R", 100).when(F.col("l_returnflag") == "A", 10).otherwise(0) + F.when(F.col("l_discount") > 0.05, 5).otherwise(0)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(p).alias("priority"))


@query("u12_same_number_other_type", "SELECT o_custkey, o_totalprice, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def u12(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_totalprice").agg(F.count_distinct("o_orderpriority").alias("kinds")).where("kinds > 1")


@query("u16_unique_join", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linestatus || l_returnflag)))[1:3], '; ') AS marks FROM lineitem GROUP BY 1")
def u16(spark, d):
    marks = F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.slice(marks, 1, 3), "; ").alias("marks"))


@query("g09_ego_network", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS kind, l_partkey AS p FROM lineitem),
b AS (SELECT s AS node, 'out' AS way, kind, p AS other FROM e UNION ALL SELECT 1000000000 + p, 'in', kind, s FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY node, way, kind ORDER BY other) AS n, count(*) OVER (PARTITION BY node, way, kind) AS total FROM b)
SELECT node, way, kind, other, total FROM r WHERE n <= 3""")
def g09(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("p")).distinct()
    out = e.select(F.col("s").alias("node"), F.lit("out").alias("way"), "kind", F.col("p").alias("other"))
    both = out.unionByName(e.select((F.col("p") + 1_000_000_000).alias("node"), F.lit("in").alias("way"), "kind", F.col("s").alias("other")))
    w = Window.partitionBy("node", "way", "kind")
    return both.withColumn("n", F.row_number().over(w.orderBy("other"))).withColumn("total", F.count("*").over(w)).where("n <= 3").drop("n")


@query("g10_edge_flags", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_shipdate < o_orderdate THEN 'before source' END, CASE WHEN l_discount > 0.08 THEN 'weak' END,
 CASE WHEN l_partkey = l_suppkey THEN 'self' END], lambda x: x IS NOT NULL) AS fs, l_tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(fs, ',') AS flags, len(fs) = 0 AND l_tax >= 0.02 AS eligible FROM e""")
def g10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    fs = quality.flags({"before source": F.col("l_shipdate") < F.col("o_orderdate"), "weak": F.col("l_discount") > 0.08, "self": F.col("l_partkey") == F.col("l_suppkey")})
    e = table(spark, d, "lineitem").join(o, "l_orderkey").withColumn("fs", fs)
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("fs", ",").alias("flags"), ((F.size("fs") == 0) & (F.col("l_tax") >= 0.02)).alias("eligible"))


@query("g08_latest_version", """SELECT o_orderkey AS node, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM orders""")
def g08(spark, d):
    o = table(spark, d, "orders")
    latest = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return o.join(latest, "o_custkey").select(F.col("o_orderkey").alias("node"), "latest")


@query("g05_decayed_expansion", """WITH e AS (SELECT DISTINCT l_suppkey AS s, 1000000000 + l_partkey AS p FROM lineitem), b AS (SELECT s AS src, p AS dst FROM e UNION SELECT p, s FROM e),
h0 AS (SELECT s_suppkey AS node, 100.0::DOUBLE AS score FROM supplier WHERE s_suppkey % 20 = 0), h1 AS (SELECT dst AS node, max(score) * 0.62 AS score FROM h0 JOIN b ON src = node GROUP BY 1),
h2 AS (SELECT dst AS node, max(score) * 0.42 AS score FROM h1 JOIN b ON src = node GROUP BY 1)
SELECT node, round(max(score), 4) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node""")
def g05(spark, d):
    """Scores fall by hop over all distinct edges; a node keeps the best that reaches it."""
    near = graphs.both_ways(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct())
    hop = table(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("node"), F.lit(100.0).alias("score"))
    seen = hop
    for decay in (0.62, 0.42):
        hop = hop.join(near, hop["node"] == near["src"]).groupBy(F.col("dst").alias("node")).agg((F.max("score") * decay).alias("score"))
        seen = seen.unionByName(hop)
    return seen.groupBy("node").agg(F.round(F.max("score"), 4).alias("score"))


@query("n04_optimistic_update", "SELECT p_partkey, CASE WHEN p_size = p_partkey % 50 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def n04(spark, d):
    """Updates of rows whose version is the expected one."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    asked = p.select("p_partkey", (F.col("p_partkey") % 50).cast("int").alias("p_size"), F.lit(True).alias("hit"))
    return p.join(asked, ["p_partkey", "p_size"], "left").select("p_partkey", F.when(F.col("hit"), F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))


@query("t03_idempotent_enqueue", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def t03(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return merging.first_of_each(e, ["user_id", "event_type", "day"], [F.asc("event_id")]).select("user_id", "event_type", "day", "event_id")


@query("t04_next_lease", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT o_custkey, o_orderkey FROM q WHERE n = 1""")
def t04(spark, d):
    waiting = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return merging.first_of_each(waiting, ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("y13_missing_children", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def y13(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("y42_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS part, l_discount AS amount FROM lineitem WHERE l_discount > 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem WHERE l_tax > 0")
def y42(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return l.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "part", "amount").where("amount > 0")


@query("s08_jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents WHERE text IS NOT NULL AND text <> ''")
def s08(spark, d):
    """Documents as compressed JSON lines, read back with a schema; rows without text are set aside."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(docs, path)
    rows, _ = files.read_jsonl(spark, path, docs.schema, ("text",))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang")

"""Aggregates, rankings, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, ranking
from .base import query, spread, table
from .retrieval import _BM25, _all_scored, _ranked


@query("a02_group_counts", """SELECT coalesce(lang, 'UNKNOWN') AS lang, coalesce(source, 'UNKNOWN') AS source, grouping(coalesce(lang, 'UNKNOWN'), coalesce(source, 'UNKNOWN')) AS level, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((coalesce(lang, 'UNKNOWN')), (coalesce(source, 'UNKNOWN')), ())""")
def a02(spark, d):
    """Several groupings of one pass; level tells which columns are summed over."""
    rows = table(spark, d, "documents").select(F.coalesce("lang", F.lit("UNKNOWN")).alias("lang"), F.coalesce("source", F.lit("UNKNOWN")).alias("source"))
    c = rows.columns
    g = rows.groupingSets([[F.col(c[0])], [F.col(c[1])], []], F.col(c[0]), F.col(c[1])).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return g.select("lang", "source", F.col("level").cast("long"), "n")


@query("a04_conditional_sums", "SELECT o_orderstatus, CAST(sum((o_totalprice > 100000)::INT) AS BIGINT) AS large, CAST(sum((o_orderpriority LIKE '1%')::INT) AS BIGINT) AS urgent FROM orders GROUP BY 1")
def a04(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent")
    )


@query("a07_mean_confidence", "SELECT l_returnflag, round(avg(1 - l_discount), 3) AS confidence, count(*) AS n FROM lineitem GROUP BY 1")
def a07(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(1 - F.col("l_discount")), 3).alias("confidence"), F.count("*").alias("n"))


@query("a10_dangling_targets", """SELECT o_custkey * 2 AS target, count(*) AS n, min(o_orderpriority) AS kind, min(o_orderkey) AS example FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2) GROUP BY 1 ORDER BY n DESC, target LIMIT 25""")
def a10(spark, d):
    """The references that lead nowhere, most frequent first (a top-k report)."""
    o = table(spark, d, "orders").withColumn("target", F.col("o_custkey") * 2)
    lost = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("target")), "target", "left_anti")
    g = lost.groupBy("target").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("kind"), F.min("o_orderkey").alias("example"))
    return g.orderBy(F.desc("n"), "target").limit(25)


@query("a11_coverage_by_code", "SELECT p_brand AS code, max(p_name) AS name, count(*) AS n FROM part GROUP BY 1")
def a11(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.max("p_name").alias("name"), F.count("*").alias("n"))


@query("a14_outcome_shares", "SELECT o_orderstatus AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def a14(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return g.select("outcome", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # one row for each status


@query("a15_chart", """SELECT 'outcome' AS chart, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'partial' END AS label, count(*) AS n FROM orders GROUP BY ALL
UNION ALL (SELECT 'issue', p_type, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, p_type LIMIT 5)""")
def a15(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("partial")
    donut = table(spark, d, "orders").groupBy(F.lit("outcome").alias("chart"), status.alias("label")).agg(F.count("*").alias("n"))
    issues = table(spark, d, "part").groupBy(F.lit("issue").alias("chart"), F.col("p_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(5)
    return donut.unionByName(issues)


_READY = """SELECT doc_id, list_filter([CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END,
 CASE WHEN NOT (coalesce(text, '') LIKE '%.%') THEN 'no sentence' END], lambda x: x IS NOT NULL) AS flags FROM documents"""


def _ready(spark, d):
    tests = {"no language": F.col("lang").isNull(), "short": F.col("n_chars") < 200, "shouting": F.col("text").contains("!!"), "no sentence": ~F.coalesce("text", F.lit("")).contains(".")}
    return spread(table(spark, d, "documents")).select("doc_id", quality.flags(tests).alias("flags"))


@query("m07_readiness", f"SELECT doc_id, round(100.0 * (4 - len(flags)) / 4, 1) AS score, array_to_string(flags, ', ') AS flags FROM ({_READY})")
def m07(spark, d):
    return _ready(spark, d).select("doc_id", F.round(100.0 * (4 - F.size("flags")) / 4, 1).alias("score"), F.array_join("flags", ", ").alias("flags"))


@query("a17_readiness_summary", f"""WITH r AS ({_READY}), s AS (SELECT count(*) AS total, count(*) FILTER (len(flags) = 0) AS complete, round(avg(100.0 * (4 - len(flags)) / 4), 4) AS mean FROM r)
SELECT total, complete, mean, flag, n FROM s, (SELECT unnest(flags) AS flag, count(*) AS n FROM r GROUP BY 1)""")
def a17(spark, d):
    """A histogram of flags beside the totals (one row, joined to each)."""
    r = _ready(spark, d)
    total = r.agg(F.count("*").alias("total"), F.count_if(F.size("flags") == 0).alias("complete"), F.round(F.avg(100.0 * (4 - F.size("flags")) / 4), 4).alias("mean"))
    return total.join(F.broadcast(r.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))))  # four flags at most


@query("a18_review_summary", """WITH k AS (SELECT 'short' AS kind, 'open' AS status FROM documents WHERE n_chars < 100 UNION ALL SELECT 'toxic', CASE WHEN quality = 1 THEN 'checked' ELSE 'open' END FROM labels WHERE toxic = 1
 UNION ALL SELECT 'error', 'open' FROM events WHERE event_type = 'error')
SELECT kind, status, count(*) AS n FROM k GROUP BY ALL""")
def a18(spark, d):
    """Items of several tables in one shape, counted by kind and status."""
    a = table(spark, d, "documents").where("n_chars < 100").select(F.lit("short").alias("kind"), F.lit("open").alias("status"))
    b = table(spark, d, "labels").where("toxic = 1").select(F.lit("toxic").alias("kind"), F.when(F.col("quality") == 1, "checked").otherwise("open").alias("status"))
    c = table(spark, d, "events").where("event_type = 'error'").select(F.lit("error").alias("kind"), F.lit("open").alias("status"))
    return a.unionByName(b).unionByName(c).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("a21_snapshot_summary", """WITH e AS (SELECT l_orderkey, l_partkey, (SELECT count(*) FROM part WHERE p_partkey = l_partkey) AS known, l_tax FROM lineitem)
SELECT count(*) AS edges, count(*) FILTER (known = 0) AS orphans, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS duplicates, count(*) FILTER (known > 0 AND l_tax >= 0.02) AS eligible,
 count(*) FILTER (known = 0) = 0 AS gate FROM e""")
def a21(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    e = table(spark, d, "lineitem").join(p, "l_partkey", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    orphans = F.count_if(~F.col("known"))
    return e.agg(
        F.count("*").alias("edges"), orphans.alias("orphans"), (F.count("*") - F.count_distinct("l_orderkey", "l_partkey")).alias("duplicates"),
        F.count_if(F.col("known") & (F.col("l_tax") >= 0.02)).alias("eligible"), (orphans == 0).alias("gate"),
    )


@query("a22_metric_blocks", f"""WITH {_BM25}, k AS (SELECT qid, rank, coalesce(quality, 0) AS g, qid % 2 AS kind, qid % 3 AS lang FROM r LEFT JOIN labels ON labels.doc_id = r.id WHERE rank <= 10),
c AS (SELECT qid, kind, lang, CAST(max(g) AS DOUBLE) AS hit, coalesce(1.0 / min(CASE WHEN g > 0 THEN rank END), 0) AS mrr FROM k GROUP BY ALL)
SELECT kind, lang, count(*) AS cases, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr FROM c GROUP BY CUBE (kind, lang)""")
def a22(spark, d):
    """Means of the cases by kind, by language, by both and over all."""
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    k = _ranked(spark, d, 10).join(gold, "id", "left").withColumn("g", F.coalesce("quality", F.lit(0)))
    c = k.groupBy("qid").agg(F.max("g").cast("double").alias("hit"), F.coalesce(1.0 / F.min(F.when(F.col("g") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"))
    c = c.withColumn("kind", F.col("qid") % 2).withColumn("lang", F.col("qid") % 3)
    return c.cube("kind", "lang").agg(F.count("*").alias("cases"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("a24_position_85", """SELECT l_suppkey, list_sort(list(l_extendedprice) FILTER (l_extendedprice > 20000))[greatest(1, CAST(floor(count(*) FILTER (l_extendedprice > 20000) * 0.85) AS INT))] AS amount FROM lineitem GROUP BY 1""")
def a24(spark, d):
    """The amount at 85 % of the places of the sorted large ones, by place in a window rather than in a list."""
    l = table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey")
    big = l.where("l_extendedprice > 20000").select("l_suppkey", "l_extendedprice", F.row_number().over(w.orderBy("l_extendedprice")).alias("at"), F.count("*").over(w).alias("n"))
    pick = big.where(F.col("at") == F.greatest(F.lit(1), F.floor(F.col("n") * 0.85))).select("l_suppkey", F.col("l_extendedprice").alias("amount"))
    return l.select("l_suppkey").distinct().join(pick, "l_suppkey", "left")


@query("a25_mean_similarity", f"WITH {_BM25} SELECT qid, round(avg(least(100, round(bm25, 6))), 1) AS similarity FROM r WHERE rank <= 5 GROUP BY 1")
def a25(spark, d):
    return _ranked(spark, d, 5).groupBy("qid").agg(F.round(F.avg(F.least(F.lit(100.0), F.round("bm25", 6))), 1).alias("similarity"))


@query("a28_unit_roll_up", """WITH u AS (SELECT conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), 'than|onen|tion')) AS hits, split_part(left(text, 20), '|', 1) AS head FROM conversations)
SELECT conv_id, max(hits) AS best, CAST(sum(hits) AS BIGINT) AS total, count(DISTINCT turn) AS units, arg_max(head, (hits, -turn)) AS first_head FROM u WHERE hits > 0 GROUP BY 1""")
def a28(spark, d):
    """Hits of a document's parts rolled up: the best part, all hits, the parts hit, and the head of the best one."""
    hits = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("than|onen|tion"))
    u = table(spark, d, "conversations").select("conv_id", "turn", hits.alias("hits"), F.split_part(F.left("text", F.lit(20)), F.lit("|"), F.lit(1)).alias("head")).where("hits > 0")
    return u.groupBy("conv_id").agg(
        F.max("hits").cast("long").alias("best"), F.sum("hits").alias("total"), F.count_distinct("turn").alias("units"),
        F.max_by("head", F.struct("hits", -F.col("turn"))).alias("first_head"),
    )


@query("a29_edge_scores", """WITH g AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_discount <= 0.05),
j AS (SELECT g.s IS NOT NULL AS gold, x.s IS NOT NULL AS found FROM g FULL JOIN x ON g.s = x.s AND g.p = x.p)
SELECT count(*) FILTER (gold AND found) AS tp, count(*) FILTER (found AND NOT gold) AS fp, count(*) FILTER (gold AND NOT found) AS fn,
 round(count(*) FILTER (gold AND found) / count(*) FILTER (found), 6) AS "precision", round(count(*) FILTER (gold AND found) / count(*) FILTER (gold), 6) AS recall FROM j""")
def a29(spark, d):
    l = table(spark, d, "lineitem")
    gold = l.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey", F.lit(1).alias("gold")).distinct()
    found = l.where("l_discount <= 0.05").select("l_suppkey", "l_partkey", F.lit(1).alias("found")).distinct()
    g, f = F.col("gold").isNotNull(), F.col("found").isNotNull()
    tp = F.count_if(g & f)
    return gold.join(found, ["l_suppkey", "l_partkey"], "full_outer").agg(
        tp.alias("tp"), F.count_if(f & ~g).alias("fp"), F.count_if(g & ~f).alias("fn"),
        F.round(F.try_divide(tp, F.count_if(f)), 6).alias("precision"), F.round(F.try_divide(tp, F.count_if(g)), 6).alias("recall"),
    )


@query("a31_distinct_sources", "SELECT lang, count(DISTINCT sha256(coalesce(text, ''))) AS texts, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def a31(spark, d):
    rows = spread(table(spark, d, "documents")).select("lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.groupBy("lang").agg(F.count_distinct("digest").alias("texts"), F.count_distinct("source").alias("sources"))


@query("a32_cost_estimate", """SELECT role, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, round(sum(ceil(length(coalesce(text, '')) / 4.0)) * CASE role WHEN 'user' THEN 0.15 WHEN 'assistant' THEN 0.60 ELSE 0.30 END / 1000000, 9) AS usd
FROM conversations GROUP BY role""")
def a32(spark, d):
    """Tokens as quarters of the characters, priced by role."""
    price = F.coalesce(F.create_map(*map(F.lit, ("user", 0.15, "assistant", 0.60)))[F.col("role")], F.lit(0.30))
    g = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("tokens"))
    return g.select("role", "tokens", F.round(F.col("tokens") * price / 1_000_000, 9).alias("usd"))


@query("a34_requirements", """WITH r AS (SELECT event_type AS category, user_id, count(*) AS have FROM events GROUP BY ALL)
SELECT category, count(*) FILTER (have >= 3) AS ready, count(*) FILTER (have = 2) AS partial, count(*) FILTER (have < 2) AS missing FROM r GROUP BY 1""")
def a34(spark, d):
    have = table(spark, d, "events").groupBy(F.col("event_type").alias("category"), "user_id").agg(F.count("*").alias("have"))
    n = F.col("have")
    return have.groupBy("category").agg(F.count_if(n >= 3).alias("ready"), F.count_if(n == 2).alias("partial"), F.count_if(n < 2).alias("missing"))


@query("w01_rank_map", f"WITH {_BM25} SELECT qid, id, rank FROM r")
def w01(spark, d):
    """The place of every matching document, counted without one task for each query: places within narrow bands
    of the score, and the rows of the bands above."""
    scored = _all_scored(spark, d).select("qid", "id", F.round("bm25", 6).alias("bm25"))
    return ranking.places(scored, ["qid"], "bm25", "id", 0.25).select("qid", "id", F.col("rank").cast("long"))


@query("w03_highest_quality", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def w03(spark, d):
    best = table(spark, d, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))
    return best.select("source", "doc_id")


@query("w04_highest_confidence", "SELECT l_suppkey, l_partkey, l_returnflag, max(1 - l_discount) AS confidence FROM lineitem GROUP BY ALL")
def w04(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.max(1 - F.col("l_discount")).alias("confidence"))


@query("w05_first_occurrences", """WITH s AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words FROM f GROUP BY doc_id""")
def w05(spark, d):
    """Distinct words in the order of their first occurrence."""
    ws = F.split(T.normalise(F.coalesce("text", F.lit(""))), " ")
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(F.array_join(F.array_distinct(ws), " ")).alias("words"))


@query("w07_domain_priority", """SELECT k, domain FROM (SELECT doc_id % 50 AS k, CASE lang WHEN 'en' THEN 'rates' WHEN 'de' THEN 'treaty' WHEN 'fr' THEN 'forms' ELSE 'guides' END AS domain,
 row_number() OVER (PARTITION BY doc_id % 50 ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) AS n FROM documents) WHERE n = 1""")
def w07(spark, d):
    """Of the domains that project one key the first by priority."""
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    names = F.array(*map(F.lit, ("rates", "treaty", "forms", "guides")))
    g = table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("k")).agg(F.min(order).alias("first"))
    return g.select("k", F.element_at(names, F.col("first") + 1).alias("domain"))


@query("w11_latest_text", "SELECT l_partkey, l_linenumber, arg_max(l_extendedprice, (l_shipdate, l_orderkey)) AS latest FROM lineitem GROUP BY ALL")
def w11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey")).alias("latest"))


@query("w12_latest_applicable", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderstatus <> 'P' GROUP BY 1")
def w12(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp")) & (F.col("o_orderstatus") != "P"))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("w13_sequence", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS seq FROM lineitem")
def w13(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w).cast("long").alias("seq"))


@query("w16_global_top", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def w16(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("w19_nulls_last", """WITH r AS (SELECT c_custkey, max(year(o_orderdate)) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, y, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY y IS NULL, y DESC, c_custkey) AS place FROM r""")
def w19(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.year("o_orderdate")).cast("long").alias("y"))
    rows = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    w = Window.partitionBy(F.col("c_custkey") % 10).orderBy(F.desc_nulls_last("y"), "c_custkey")
    return rows.select("c_custkey", "y", F.row_number().over(w).cast("long").alias("place"))


@query("w22_busiest_nodes", """WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem), g AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)
SELECT node, CAST(o AS BIGINT) AS out_degree, CAST(i AS BIGINT) AS in_degree FROM g ORDER BY o + i DESC, node LIMIT 20""")
def w22(spark, d):
    from ..operators import graphs

    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct()
    return graphs.degrees(e).orderBy((F.col("out_degree") + F.col("in_degree")).desc(), "node").limit(20)


@query("u01_corpus_union", "SELECT 'document' AS corpus, doc_id AS id, source, NULL AS role FROM documents UNION ALL SELECT 'conversation', conv_id * 1000 + turn, NULL, role FROM conversations")
def u01(spark, d):
    a = table(spark, d, "documents").select(F.lit("document").alias("corpus"), F.col("doc_id").alias("id"), "source")
    b = table(spark, d, "conversations").select(F.lit("conversation").alias("corpus"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_union_of_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def u02(spark, d):
    a, b, c = (table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "lineitem", "documents"))
    return a.unionAll(b).unionAll(c)


@query("u04_fillable_gaps", """WITH n AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)
SELECT DISTINCT n.o_custkey, e.l_orderkey AS fill FROM n JOIN lineitem e ON e.l_orderkey > n.o_orderkey AND e.l_orderkey < n.nx WHERE n.nx - n.o_orderkey BETWEEN 2 AND 5""")
def u04(spark, d):
    """Missing numbers of short gaps that another source has: gaps are listed, then joined on equality."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("nx")).where("nx - o_orderkey BETWEEN 2 AND 5")
    gaps = n.select("o_custkey", F.explode(F.sequence(F.col("o_orderkey") + 1, F.col("nx") - 1)).alias("fill"))
    return gaps.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fill")), "fill", "left_semi").select("o_custkey", "fill").distinct()


@query("u09_node_collapse", """SELECT source || '|' || coalesce(lang, '') AS key, count(*) AS n, arg_min(doc_id, doc_id) AS node, arg_min(left(text, 30), doc_id) FILTER (coalesce(text, '') <> '') AS head,
 count(DISTINCT n_chars) > 1 AS differs FROM documents GROUP BY source || '|' || coalesce(lang, '')""")
def u09(spark, d):
    """Rows that share a key become one node; each field is its first value that is not blank."""
    key = F.concat("source", F.lit("|"), F.coalesce("lang", F.lit("")))
    head = F.when(F.coalesce("text", F.lit("")) != "", F.left("text", F.lit(30)))
    return table(spark, d, "documents").groupBy(key.alias("key")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("node"), F.min_by(head, F.when(head.isNotNull(), F.col("doc_id"))).alias("head"), (F.count_distinct("n_chars") > 1).alias("differs")
    )


@query("u14_alert_union", """WITH old AS (SELECT event_id, user_id || ':' || event_type AS key FROM events WHERE ts < TIMESTAMP '2024-01-15'), new AS (SELECT event_id, user_id || ':' || event_type AS key, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
f AS (SELECT min(event_id) AS event_id, key FROM new WHERE key NOT IN (SELECT key FROM old) GROUP BY key)
SELECT event_id, key FROM old UNION ALL SELECT event_id, key FROM f""")
def u14(spark, d):
    """New alerts join the old ones unless their key stands there; of new ones with one key the first."""
    e = table(spark, d, "events").select("event_id", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    at = F.lit("2024-01-15").cast("timestamp")
    old, new = e.where(F.col("ts") < at), e.where(F.col("ts") >= at)
    fresh = new.join(old.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("event_id").alias("event_id"))
    return old.select("event_id", "key").unionByName(fresh)


@query("u15_saved_once", "SELECT event_type, user_id, count(*) AS times, min(event_id) AS first FROM events GROUP BY ALL")
def u15(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("times"), F.min("event_id").alias("first"))


@query("u17_merged_parts", """SELECT conv_id, arg_min(text, turn) FILTER (coalesce(text, '') <> '') AS opening, list_sort(list(DISTINCT role)) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS whole FROM conversations GROUP BY 1""")
def u17(spark, d):
    """Parts of one record: the first scalar that is there, the union of lists, the narratives joined in order."""
    filled = F.when(F.coalesce("text", F.lit("")) != "", F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by(filled, F.when(filled.isNotNull(), F.col("turn"))).alias("opening"), F.array_sort(F.collect_set("role")).alias("roles"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")).alias("whole"),
    )

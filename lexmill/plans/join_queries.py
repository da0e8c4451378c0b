"""Joins: look-ups on both ends, derived keys, candidates in order, containment, overlap, gold sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching
from .base import query, spread, table
from .retrieval import _BM25, _ranked
from .text_queries import _TOKENS


@query("j02_posting_hits", f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), h AS (SELECT doc_id, count(*) AS hits FROM t WHERE token IN ('license', 'password', 'than') GROUP BY 1)
SELECT doc_id, source, hits FROM h JOIN documents USING (doc_id)""")
def j02(spark, d):
    docs = spread(table(spark, d, "documents"))
    hits = docs.select("doc_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("token")).where(F.col("token").isin("license", "password", "than"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits")).join(docs, "doc_id").select("doc_id", "source", "hits")


@query("j03_orders_with_lines", "SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(max(l_linenumber), 0) AS last_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j03(spark, d):
    """Children are counted before the join, so the join carries one row for each parent."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.max("l_linenumber").alias("last_line"))
    return table(spark, d, "orders").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("last_line", F.lit(0)).alias("last_line"))


@query("j04_documents_with_labels", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j04(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")


@query("j05_lateral_completeness", "SELECT doc_id, c.filled FROM documents d LEFT JOIN LATERAL (SELECT (d.lang IS NOT NULL)::INT + (d.source IS NOT NULL)::INT + (coalesce(d.text, '') <> '')::INT AS filled) c ON true")
def j05(spark, d):
    """A lateral subquery of one row is a column."""
    filled = [F.col("lang").isNotNull(), F.col("source").isNotNull(), F.coalesce("text", F.lit("")) != ""]
    return table(spark, d, "documents").select("doc_id", sum((c.cast("int") for c in filled), F.lit(0)).alias("filled"))


@query("j06_members", "SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def j06(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_nationkey", "n_nationkey")
    return table(spark, d, "nation").join(c, "n_nationkey").select("n_name", "c_custkey")


_STEP = "SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders"


def chain_edges(spark, d):
    """src, dst: an order and the customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))


@query("j07_both_ends", f"SELECT src, dst, a.o_orderpriority AS src_kind, b.o_orderpriority AS dst_kind FROM ({_STEP}) JOIN orders a ON a.o_orderkey = src LEFT JOIN orders b ON b.o_orderkey = dst")
def j07(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.select(F.col("o_orderkey").alias(c), F.col("o_orderpriority").alias(f"{c}_kind")) for c in ("src", "dst"))
    return chain_edges(spark, d).join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_kind", "dst_kind")


@query("j08_cross_tab", "SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def j08(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("quality", "lang").agg(F.count("*").alias("n"))


@query("j11_exists_on_expressions", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 25 = CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AND s_nationkey = p_size % 25)")
def j11(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("brand"), F.col("s_nationkey").alias("size"))
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").cast("long").alias("brand"), (F.col("p_size") % 25).alias("size"))
    return p.join(s, ["brand", "size"], "left_semi").select("p_partkey")


@query("j16_suffix_links", """WITH k AS (SELECT regexp_replace(c_name, '^[^#]+#', '') AS suffix, count(*) AS n, min(c_custkey) AS target FROM customer GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'dangling' END AS method
FROM orders LEFT JOIN k ON suffix = lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0')""")
def j16(spark, d):
    """A raw reference is linked to the key that equals it after its type prefix, if there is just one."""
    k = matching.unique_targets(table(spark, d, "customer").withColumn("suffix", F.regexp_replace("c_name", "^[^#]+#", "")), ["suffix"], "c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0").alias("suffix"))
    method = F.when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("dangling")
    return o.join(k, "suffix", "left").select("o_orderkey", F.when(F.col("n") == 1, F.col("target")).alias("target"), method.alias("method"))


@query("j17_first_candidate", """WITH c AS (SELECT c_custkey, unnest([regexp_replace(c_name, '^Customer#0*', ''), CAST(c_nationkey AS VARCHAR), '7']) AS cand, unnest([0, 1, 2]) AS pos FROM customer),
h AS (SELECT c_custkey, pos, s_suppkey FROM c JOIN supplier ON CAST(s_suppkey AS VARCHAR) = cand)
SELECT c_custkey, arg_min(s_suppkey, pos) AS s_suppkey, min(pos) AS tier FROM h GROUP BY 1""")
def j17(spark, d):
    """Candidate keys of a name, tried in order; the first that exists wins."""
    cands = F.array(F.regexp_replace("c_name", "^Customer#0*", ""), F.col("c_nationkey").cast("string"), F.lit("7"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("cand"), "s_suppkey")
    return matching.first_candidate(table(spark, d, "customer").select("c_custkey", cands.alias("cands")), "c_custkey", "cands", s, "cand", "s_suppkey")


@query("j20_rate_series", """SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, round(avg(l_extendedprice / l_quantity), 4) AS rate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL""")
def j20(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp")))
    rows = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("rate"))


@query("j22_lookup_in_order", """WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_transform(roles, lambda x: CASE x WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE '?' END), '') AS marks FROM r""")
def j22(spark, d):
    """A look-up map keeps the order of the references."""
    mark = F.coalesce(F.create_map(*map(F.lit, ("user", "U", "assistant", "A")))[F.col("role")], F.lit("?"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mark.alias("m")))).alias("ms"))
    return g.select("conv_id", F.array_join(F.transform("ms", lambda x: x["m"]), "").alias("marks"))


@query("j23_token_overlap", f"""WITH b AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS token FROM benchmark), c AS (SELECT DISTINCT conv_id, unnest({_TOKENS}) AS token FROM conversations WHERE role = 'user')
SELECT conv_id, item_id, count(*) AS shared FROM c JOIN b USING (token) WHERE length(token) > 3 GROUP BY ALL""")
def j23(spark, d):
    """Texts that share a word of over three characters: an equal join on distinct words in place of a loop over all pairs."""
    def rows(df, key):
        return df.select(key, F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("token")).where(F.length("token") > 3)

    c = rows(table(spark, d, "conversations").where("role = 'user'"), "conv_id").distinct()
    return c.join(rows(table(spark, d, "benchmark"), "item_id"), "token").groupBy("conv_id", "item_id").agg(F.count("*").alias("shared"))


@query("j24_containment", """WITH k AS (SELECT s_suppkey, '9' || s_suppkey || '00' AS key FROM supplier WHERE length('9' || s_suppkey || '00') >= 5), n AS (SELECT o_orderkey, '9' || o_orderkey AS num FROM orders WHERE length('9' || o_orderkey) >= 5)
SELECT o_orderkey, s_suppkey FROM n JOIN k ON contains(num, key) OR contains(key, num)""")
def j24(spark, d):
    """Either number holds the other: joined by their 5-character pieces, then tested, so no pair without a
    common piece is ever formed."""
    k = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("9"), F.col("s_suppkey").cast("string"), F.lit("00")).alias("key")).where("length(key) >= 5")
    n = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("9"), F.col("o_orderkey").cast("string")).alias("num")).where("length(num) >= 5")
    return matching.containing(n, "num", k, "key", 5).select("o_orderkey", "s_suppkey")


@query("j26_ranked_against_gold", f"""WITH {_BM25} SELECT qid, id, rank, CASE WHEN quality = 1 THEN 'required' WHEN toxic = 1 THEN 'forbidden' WHEN quality = 0 THEN 'supporting' ELSE 'none' END AS role
FROM r LEFT JOIN labels ON labels.doc_id = r.id WHERE rank <= 10""")
def j26(spark, d):
    gold = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    role = F.when(F.col("quality") == 1, "required").when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 0, "supporting").otherwise("none")
    return _ranked(spark, d, 10).join(gold, "id", "left").select("qid", "id", F.col("rank").cast("long"), role.alias("role"))


@query("j27_accessible", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') OR c_mktsegment = 'BUILDING'")
def j27(spark, d):
    """Elevated rows pass; the others need a membership."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    member = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.where("c_mktsegment = 'BUILDING'").select("c_custkey").unionByName(c.where("c_mktsegment <> 'BUILDING'").join(member, "c_custkey", "left_semi").select("c_custkey"))

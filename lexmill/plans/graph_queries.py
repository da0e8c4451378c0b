"""Graphs: ranks and years of edges, expansion, induced paths, citations, change feeds, job graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs, matching
from ..sources.files import settle
from .base import query, spread, table
from .join_queries import chain_edges
from .retrieval import _BM25, _ranked

_CHAIN = "SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders"
_ENDS = f"""SELECT src, dst, CAST(left(a.o_orderpriority, 1) AS INT) AS src_rank, CAST(left(b.o_orderpriority, 1) AS INT) AS dst_rank, a.o_totalprice AS src_price, b.o_totalprice AS dst_price, a.o_orderstatus AS kind
 FROM ({_CHAIN}) JOIN orders a ON a.o_orderkey = src JOIN orders b ON b.o_orderkey = dst"""


def _ends(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("kind"))
    a = o.select(F.col("o_orderkey").alias("src"), F.col("rank").alias("src_rank"), F.col("price").alias("src_price"), "kind")
    b = o.select(F.col("o_orderkey").alias("dst"), F.col("rank").alias("dst_rank"), F.col("price").alias("dst_price"))
    return chain_edges(spark, d).join(a, "src").join(b, "dst")


@query("g01_rank_violations", f"SELECT src, dst, src_rank, dst_rank FROM ({_ENDS}) WHERE kind = 'F' AND src_rank > dst_rank")
def g01(spark, d):
    """A lower rank must not change a higher one."""
    return _ends(spark, d).where("kind = 'F' AND src_rank > dst_rank").select("src", "dst", "src_rank", "dst_rank")


@query("g12_time_violations", f"SELECT src, dst FROM ({_ENDS}) WHERE kind <> 'P' AND src_price < dst_price")
def g12(spark, d):
    """The source lies before its target on the measure that ought to fall."""
    return _ends(spark, d).where("kind <> 'P' AND src_price < dst_price").select("src", "dst")


_LINKS = "SELECT DISTINCT doc_id AS src, (doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents) AS dst FROM documents WHERE n_chars >= 200"


def _doc_links(spark, d):
    """An eligible edge of each longer document; the modulus is one aggregated row."""
    docs = table(spark, d, "documents")
    top = docs.agg((F.max("doc_id") + 1).alias("n"))
    return docs.where("n_chars >= 200").join(F.broadcast(top)).select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("dst")).distinct()


@query("g03_expanded_hits", f"""WITH {_BM25}, e AS ({_LINKS}), nb AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT qid, id, rank FROM r WHERE rank <= 10)
SELECT DISTINCT qid, nb.dst AS id FROM k JOIN nb ON nb.src = k.id JOIN documents ON doc_id = nb.dst WHERE rank <= 4 AND NOT EXISTS (SELECT 1 FROM k x WHERE x.qid = k.qid AND x.id = nb.dst)""")
def g03(spark, d):
    """Neighbours of the four best hits that are in the corpus and not among the hits."""
    k = settle(_ranked(spark, d, 10).select("qid", "id", "rank"), "hits")
    near = graphs.both_ways(_doc_links(spark, d)).select(F.col("src").alias("id"), "dst").distinct()
    found = k.where("rank <= 4").join(near, "id").select("qid", F.col("dst").alias("id")).distinct()
    return found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi").join(k.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id")


@query("g06_induced_paths", f"""WITH {_BM25}, e AS ({_LINKS}), k AS (SELECT qid, id FROM r WHERE rank <= 60),
p AS (SELECT DISTINCT a.qid, src, dst FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst AND b.qid = a.qid)
SELECT qid, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY src, dst) AS n FROM p) WHERE n <= 12""")
def g06(spark, d):
    """Edges both of whose ends were selected for a question, twelve for each."""
    k = settle(_ranked(spark, d, 60).select("qid", "id"), "hits")
    p = _doc_links(spark, d).join(k.withColumnRenamed("id", "src"), "src").join(k.withColumnRenamed("id", "dst"), ["qid", "dst"]).select("qid", "src", "dst").distinct()
    w = Window.partitionBy("qid").orderBy("src", "dst")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 12").drop("n")


@query("g13_citation_index", """WITH t AS (SELECT p_type, p_size, count(*) AS n, min(p_partkey) AS target FROM part GROUP BY ALL), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type, CAST(l_quantity AS INT) AS size FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 AND target = l_partkey THEN 'self' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN n = 1 THEN target END AS target
FROM c LEFT JOIN t ON t.p_type = c.p_type AND t.p_size = c.size""")
def g13(spark, d):
    """Every reference is resolved, ambiguous, unresolved, or to its own source."""
    p = table(spark, d, "part")
    t = matching.unique_targets(p.withColumnRenamed("p_size", "size"), ["p_type", "size"], "p_partkey")
    c = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").withColumn("size", F.col("l_quantity").cast("int"))
    one = F.col("n") == 1
    state = F.when(one & (F.col("target") == F.col("l_partkey")), "self").when(one, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return c.join(t, ["p_type", "size"], "left").select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"), F.when(one, F.col("target")).alias("target"))


@query("g14_review_list", f"SELECT src, dst, src_price FROM ({_ENDS}) WHERE kind = 'F' AND src_rank > dst_rank ORDER BY src_price DESC NULLS LAST, src LIMIT 200")
def g14(spark, d):
    """Conflicting edges by weight (a list of 200)."""
    return _ends(spark, d).where("kind = 'F' AND src_rank > dst_rank").select("src", "dst", "src_price").orderBy(F.desc_nulls_last("src_price"), "src").limit(200)


@query("g15_cancelled_descendants", """WITH c AS (SELECT o_orderkey AS node, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT node FROM c WHERE n > (SELECT min(n) FROM c x WHERE x.o_custkey = c.o_custkey AND x.o_orderstatus = 'P')""")
def g15(spark, d):
    """All jobs behind a failed one: chains end in their last node; what a failed node reaches is cancelled."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus")
    links = chain_edges(spark, d).where("dst IS NOT NULL").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    return graphs.descendants(links, o.where("o_orderstatus = 'P'").select("node"))


@query("g16_stage_plan", """WITH s AS (SELECT o_orderkey, o_orderstatus, lag(o_orderkey) OVER w AS d1, lag(o_orderkey, 2) OVER w AS d2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT s.o_orderkey, CASE WHEN s.o_orderstatus = 'F' THEN 'completed' WHEN coalesce(a.o_orderstatus, 'F') = 'F' AND coalesce(b.o_orderstatus, 'F') = 'F' THEN CASE WHEN s.o_orderstatus = 'P' THEN 'human' ELSE 'ready' END ELSE 'blocked' END AS state
FROM s LEFT JOIN orders a ON a.o_orderkey = d1 LEFT JOIN orders b ON b.o_orderkey = d2""")
def g16(spark, d):
    """A stage is ready when each of its dependencies is complete; some wait for a person."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    deps = F.array_compact(F.array(F.lag("o_orderkey").over(w), F.lag("o_orderkey", 2).over(w)))
    s = o.select("o_orderkey", "o_orderstatus", deps.alias("deps"))
    open_ = graphs.unmet(s, "o_orderkey", "deps", o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dep")))
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.coalesce("unmet", F.lit(0)) > 0, "blocked").when(F.col("o_orderstatus") == "P", "human").otherwise("ready")
    return s.join(open_, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("g18_change_feed", f"SELECT src, dst, 'changed by ' || a.o_orderpriority AS title, CAST(b.o_orderdate AS DATE) AS day FROM ({_CHAIN}) JOIN orders a ON a.o_orderkey = src JOIN orders b ON b.o_orderkey = dst WHERE a.o_orderstatus = 'F'")
def g18(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src"), F.concat(F.lit("changed by "), "o_orderpriority").alias("title"))
    b = o.select(F.col("o_orderkey").alias("dst"), F.to_date("o_orderdate").alias("day"))
    return chain_edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", "title", "day")


@query("g19_glossary_links", """WITH s(term, pattern) AS (VALUES ('key', 'password|secret'), ('grant', 'license'), ('lot', 'onen')), h AS (SELECT term, d.doc_id, coalesce(quality, 0) AS q FROM s JOIN documents d ON regexp_matches(lower(coalesce(text, '')), pattern) LEFT JOIN labels USING (doc_id))
SELECT term, arg_min(doc_id, (-q, doc_id)) AS doc_id FROM h GROUP BY term""")
def g19(spark, d):
    """Of each term the first checked document that matches its pattern, else the first. A few terms of bounded
    number: one pass with a test for each, no join on patterns."""
    low = F.lower(F.coalesce("text", F.lit("")))
    terms = (("key", "password|secret"), ("grant", "license"), ("lot", "onen"))
    hits = spread(table(spark, d, "documents")).select("doc_id", F.explode(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in terms]))).alias("term"))
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return hits.join(q, "doc_id", "left").groupBy("term").agg(F.min_by("doc_id", F.struct(-F.coalesce("q", F.lit(0)), "doc_id")).alias("doc_id"))


@query("g20_book_graph", """SELECT 'source' AS kind, 'conv-' || conv_id AS src, 'turn-' || conv_id || '-' || turn AS dst FROM conversations UNION ALL SELECT 'role', 'turn-' || conv_id || '-' || turn, role FROM conversations""")
def g20(spark, d):
    """Edges of several kinds by projection and union."""
    conv, turn = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    c = table(spark, d, "conversations")
    return c.select(F.lit("source").alias("kind"), conv.alias("src"), turn.alias("dst")).unionByName(c.select(F.lit("role").alias("kind"), turn.alias("src"), F.col("role").alias("dst")))


@query("g31_silver_labels", """WITH x AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A')
SELECT src, dst FROM x WHERE (src IN (SELECT src FROM g) OR dst IN (SELECT dst FROM g)) AND NOT EXISTS (SELECT 1 FROM g WHERE g.src = x.src AND g.dst = x.dst)""")
def g31(spark, d):
    """Outside edges with an end that the graph knows, without those it has already."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    x, g = (l.where(F.col("l_returnflag") == f).select("src", "dst").distinct() for f in "RA")
    known = x.join(g.select("src").distinct(), "src", "left_semi").unionByName(x.join(g.select("dst").distinct(), "dst", "left_semi")).distinct()
    return known.join(g, ["src", "dst"], "left_anti")


@query("y48_lineage", """WITH c AS (SELECT o_orderkey AS node, o_custkey, o_orderpriority AS input, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT a.node, b.node AS ancestor FROM c a JOIN c b ON b.o_custkey = a.o_custkey AND b.n < a.n WHERE a.node % 20 = 0
 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.o_custkey = a.o_custkey AND x.n >= b.n AND x.n < a.n AND x.input <> a.input)""")
def y48(spark, d):
    """Dependencies of the asked runs, transitively, as long as the input stays the same; a hop joins its frontier only."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("input"))
    e = chain_edges(spark, d).where("dst IS NOT NULL").join(o.select(F.col("node").alias("src"), F.col("input").alias("si")), "src").join(o.select(F.col("node").alias("dst"), F.col("input").alias("di")), "dst")
    up = e.where("si = di").select(F.col("dst").alias("node"), F.col("src").alias("next"))
    return graphs.walk(up, o.where("node % 20 = 0").select("node")).select("node", F.col("reached").alias("ancestor"))

"""Validity, as-of lookups, chains, reachability, degrees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs, temporal
from .base import query, table


@query("f02_valid_on", """WITH v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS t FROM orders)
SELECT o_orderkey FROM v WHERE f <= DATE '1998-06-30' AND coalesce(t, DATE '9999-12-31') >= DATE '1998-06-30'""")
def f02(spark, d):
    v = temporal.intervals(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "o_orderdate", "o_orderkey")
    return v.where(temporal.valid_on(F.lit("1998-06-30").cast("date"), F.col("day"), F.to_date("valid_to"))).select("o_orderkey")


@query("f03_status_on", """WITH v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS t FROM orders)
SELECT CASE WHEN DATE '1998-06-30' < f THEN 'not yet' WHEN DATE '1998-06-30' >= t THEN 'ended' ELSE 'in force' END AS status, count(*) AS n FROM v GROUP BY 1""")
def f03(spark, d):
    v = temporal.intervals(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    status = temporal.status_on(F.lit("1998-06-30").cast("date"), F.to_date("o_orderdate"), F.to_date("valid_to"))
    return v.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("d03_validity_intervals", "SELECT o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def d03(spark, d):
    return temporal.intervals(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), "valid_to")


@query("j18_as_of_rate", """WITH r AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, round(avg(o_totalprice), 2) AS rate FROM orders GROUP BY ALL),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, r.rate FROM f ASOF LEFT JOIN r ON f.o_orderpriority = r.o_orderpriority AND f.l_shipdate >= r.m""")
def j18(spark, d):
    """The monthly mean price of an order's priority that holds when a line ships. A month is part
    of the key, and only the month's start is filled down, so no key is larger than one month."""
    o = table(spark, d, "orders")
    rates = o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("rate"))
    facts = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    facts = facts.withColumn("month", F.date_trunc("month", "l_shipdate"))
    asked = temporal.as_of(facts.select("o_orderpriority", "month").distinct(), rates.withColumnRenamed("month", "since"), ["o_orderpriority"], "month", "since", ["rate"])
    return facts.join(asked, ["o_orderpriority", "month"]).select("l_orderkey", "l_linenumber", "l_partkey", "rate")


@query("j19_neighbours", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def j19(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@query("w10_first_and_last_amender", "SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS first_order, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS last_order FROM lineitem GROUP BY 1")
def w10(spark, d):
    at = F.struct("l_shipdate", "l_orderkey")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", at).alias("first_order"), F.max_by("l_orderkey", at).alias("last_order"))


_CHAIN = "SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders"


@query("g07_chain_walk", """WITH c AS (SELECT o_orderkey AS node, last_value(o_orderkey) OVER w AS last, count(*) OVER w - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS steps
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT node, last, steps FROM c WHERE steps > 0""")
def g07(spark, d):
    """Each order's newest successor by pointer doubling."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.lead("o_orderkey").over(w).alias("next")).where("next is not null")
    return graphs.chain_ends(links)


@query("g04_reach_three_hops", """WITH e AS (SELECT DISTINCT l_suppkey AS s, 1000000000 + l_partkey AS p FROM lineitem),
b AS (SELECT s AS src, p AS dst FROM e UNION SELECT p, s FROM e),
h0 AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey % 20 = 0),
h1 AS (SELECT DISTINCT seed, dst AS node FROM h0 JOIN b ON src = node), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN b ON src = node), h3 AS (SELECT DISTINCT seed, dst AS node FROM h2 JOIN b ON src = node)
SELECT seed, node, min(depth) AS depth FROM (SELECT * FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY ALL""")
def g04(spark, d):
    """Three hops over all distinct edges from the seeds (a stated query set)."""
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"))
    seeds = table(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("node"))
    return graphs.reach(edges, seeds, 3)


@query("g11_contradictory_edges", "SELECT l_suppkey AS src, l_partkey AS dst, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def g11(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count_distinct("l_returnflag").alias("kinds"))
    return g.where("kinds > 1")


@query("g17_hierarchy_rollup", """SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def g17(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"), F.sum("c_acctbal").alias("b"))
    n = table(spark, d, "nation").join(c, "n_nationkey", "left")
    rows = table(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy("r_name").agg(
        F.count_distinct("n_nationkey").alias("nations"), F.coalesce(F.sum("k"), F.lit(0)).alias("customers"), F.round(F.coalesce(F.sum("b"), F.lit(0.0)), 2).alias("balance")
    )


@query("g22_degrees", """WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node""")
def g22(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct()
    return graphs.degrees(e)


@query("g30_stratified_sample", """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '~7'), doc_id) AS n FROM documents) WHERE n <= 5""")
def g30(spark, d):
    docs = table(spark, d, "documents").withColumn("stratum", F.concat_ws("|", "lang", "source"))
    return graphs.stratified(docs, "stratum", "doc_id", 5, 7).select("lang", "doc_id")

"""Joins, aggregates, windows, set operations and merges over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import merging
from .base import query, table


@query("j01_join_chain", """SELECT n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def j01(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("j09_left_join_on_predicate", "SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def j09(spark, d):
    o = table(spark, d, "orders")
    rows = table(spark, d, "customer").join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "O"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


@query("j10_semi_join", "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def j10(spark, d):
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(l, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("j12_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("j13_anti_join_either_key", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE (l_suppkey = s_suppkey AND l_returnflag = 'A' AND l_quantity > 49) OR (l_partkey = s_suppkey AND l_quantity < 2))")
def j13(spark, d):
    """Two anti joins on equal keys in place of one nested loop with OR."""
    l = table(spark, d, "lineitem")
    a = l.where("l_returnflag = 'A' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    b = l.where("l_quantity < 2").select(F.col("l_partkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(a, "s_suppkey", "left_anti").join(b, "s_suppkey", "left_anti").select("s_suppkey")


@query("j14_match_cascade", """WITH k AS (SELECT n_nationkey, n_name FROM nation), a AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier),
m AS (SELECT c_custkey, (SELECT min(s_suppkey) FROM a WHERE s_suppkey = c_custkey) AS by_key,
 (SELECT min(s_suppkey) FROM a WHERE s_nationkey = c_nationkey) AS by_nation FROM customer)
SELECT c_custkey, coalesce(by_key, by_nation) AS s_suppkey, CASE WHEN by_key IS NOT NULL THEN 'key' WHEN by_nation IS NOT NULL THEN 'nation' ELSE 'none' END AS tier FROM m""")
def j14(spark, d):
    s = table(spark, d, "supplier")
    by_key = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("by_key"))
    by_nation = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("by_nation"))
    m = table(spark, d, "customer").join(by_key, "c_custkey", "left").join(by_nation, "c_nationkey", "left")
    tier = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_nation").isNotNull(), "nation").otherwise("none")
    return m.select("c_custkey", F.coalesce("by_key", "by_nation").alias("s_suppkey"), tier.alias("tier"))


@query("j15_unique_alias_join", """WITH a AS (SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS target FROM part GROUP BY ALL)
SELECT p.p_partkey, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS note FROM part p JOIN a USING (p_brand, p_type, p_size)""")
def j15(spark, d):
    p = table(spark, d, "part")
    a = p.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("target"))
    one = F.col("n") == 1
    return p.join(a, ["p_brand", "p_type", "p_size"]).select("p_partkey", F.when(one, F.col("target")).alias("target"), F.when(one, "unique").otherwise("ambiguous").alias("note"))


@query("j21_full_outer_diff", """WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS part_key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.q <> b.q THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def j21(spark, d):
    l = table(spark, d, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("part_key")).agg(F.sum("l_quantity").alias(f"q{f}")) for f in "AR")
    change = F.when(F.col("qA").isNull(), "added").when(F.col("qR").isNull(), "removed").when(F.col("qA") != F.col("qR"), "changed").otherwise("unchanged")
    return a.join(b, "part_key", "full_outer").select("part_key", change.alias("change"))


@query("j25_ready_jobs", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dep FROM orders)
SELECT o.o_orderkey, o.dep IS NULL OR p.o_orderstatus = 'F' AS ready FROM o LEFT JOIN orders p ON p.o_orderkey = o.dep""")
def j25(spark, d):
    """A job waits for the one before it in its chain."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    jobs = o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("dep"))
    done = o.select(F.col("o_orderkey").alias("dep"), (F.col("o_orderstatus") == "F").alias("done"))
    return jobs.join(done, "dep", "left").select("o_orderkey", (F.col("dep").isNull() | F.coalesce("done", F.lit(False))).alias("ready"))


@query("j28_scalar_subqueries", """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines,
 (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier""")
def j28(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    return table(spark, d, "supplier").join(g, "s_suppkey", "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("a01_counters", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey || '#' || l_partkey) AS pairs FROM lineitem")
def a01(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs")
    )


@query("a03_metrics_long", """SELECT 'status' AS metric_group, o_orderstatus AS metric_key, CAST(count(*) AS DOUBLE) AS metric_value FROM orders GROUP BY ALL
UNION ALL SELECT 'priority', o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY ALL
UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM orders GROUP BY ALL""")
def a03(spark, d):
    """Several groupings in one aggregation."""
    each = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate").cast("string")}
    long = table(spark, d, "orders").select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric_group"), v.alias("metric_key")) for k, v in each.items()])))
    return long.groupBy("metric_group", "metric_key").agg(F.count("*").cast("double").alias("metric_value"))


@query("a05_group_case_bucket", """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS bucket, l_linestatus,
 min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL""")
def a05(spark, d):
    bucket = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large")
    return table(spark, d, "lineitem").groupBy(bucket.alias("bucket"), "l_linestatus").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query("a06_having", "SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 3) AS mean_discount FROM lineitem GROUP BY l_suppkey HAVING count(*) - count(*) FILTER (l_returnflag = 'N') > 0")
def a06(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 3).alias("mean_discount"), F.count_if(F.col("l_returnflag") == "N").alias("kept"))
    return g.where("n - kept > 0").drop("kept")


@query("a08_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a08(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("a09_row_of_minimum", "SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def a09(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_orderpriority", "o_orderkey").alias("priority"))


@query("a13_weighted_distribution", """WITH g AS (SELECT event_type, sum(greatest(1, value)) AS w FROM events GROUP BY 1)
SELECT event_type, round(w, 3) AS weight, round(w / sum(w) OVER (), 3) AS share FROM g""")
def a13(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.greatest(F.lit(1.0), "value")).alias("w"))
    total = g.agg(F.sum("w").alias("t"))
    return g.join(F.broadcast(total)).select("event_type", F.round("w", 3).alias("weight"), F.round(F.col("w") / F.col("t"), 3).alias("share"))  # one row


@query("a19_monthly_usage", """SELECT strftime(ts, '%Y-%m') AS month, user_id, count(*) AS n, round(sum(value), 4) AS spent, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""")
def a19(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@query("a20_status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a20(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c) for c in "FOP"])


@query("a23_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a23(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))]
    )


@query("a30_agreement", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a30(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("w02_best_per_key", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def w02(spark, d):
    return merging.first_of_each(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("w06_twin_merge", """WITH n AS (SELECT doc_id, source, md5(lower(trim(coalesce(text, '')))) AS h FROM documents)
SELECT h AS text_md5, min(doc_id) AS kept, count(*) - 1 AS aliases, count(DISTINCT source) AS sources FROM n GROUP BY h HAVING count(*) > 1""")
def w06(spark, d):
    n = table(spark, d, "documents").select("doc_id", "source", F.md5(F.lower(F.trim(F.coalesce("text", F.lit(""))))).alias("text_md5"))
    g = n.groupBy("text_md5").agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("aliases"), F.count_distinct("source").alias("sources"))
    return g.where("aliases > 0")


@query("w08_occurrence_suffix", """SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS unit_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)""")
def w08(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey"))
    rows = table(spark, d, "lineitem").withColumn("n", n)
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("~"), "n")).otherwise("")).alias("unit_id"))


@query("w09_limit_with_true_count", """SELECT o_custkey, o_orderkey, n, total FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n,
 count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE n <= 3""")
def w09(spark, d):
    w = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("n"), F.count("*").over(w).alias("total"))
    return rows.where("n <= 3")


@query("w14_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def w14(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("w15_first_crossing", """WITH r AS (SELECT o_custkey, o_orderdate, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders)
SELECT o_custkey, min(o_orderdate) AS crossed FROM r WHERE s >= 1000000 GROUP BY 1""")
def w15(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, d, "orders").withColumn("s", F.sum("o_totalprice").over(w))
    return r.where("s >= 1000000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("crossed"))


@query("w17_case_ordered_top", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25""")
def w17(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("w20_page", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def w20(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("y36_slot_reservation", """WITH r AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
f AS (SELECT p_partkey, p_retailprice, n <= 2 AS reserved FROM r)
SELECT p_partkey, reserved FROM f ORDER BY reserved DESC, p_retailprice DESC, p_partkey LIMIT 400""")
def y36(spark, d):
    """Two slots for each type, the rest by price."""
    n = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    r = table(spark, d, "part").select("p_partkey", "p_retailprice", (n <= 2).alias("reserved"))
    return r.orderBy(F.desc("reserved"), F.desc("p_retailprice"), "p_partkey").limit(400).select("p_partkey", "reserved")


@query("u05_edge_sets", """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first,
 (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second""")
def u05(spark, d):
    """Both differences and the intersection from one pass: flags for each pair."""
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    return g.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second")
    )


@query("u07_merge_records", """SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS priority, count(*) AS n FROM orders GROUP BY 1""")
def u07(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"))
    best = merging.prefer(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return best.join(o.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey").select("o_custkey", "priority", "n")


@query("u08_conflict_queue", """WITH l AS (SELECT o_custkey, o_orderkey, unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders),
g AS (SELECT o_custkey, field, arg_min(value, o_orderkey) AS kept, list_sort(list_distinct(list(value))) AS vs FROM l GROUP BY ALL)
SELECT o_custkey, field, kept, array_to_string(list_filter(vs, lambda v: v <> kept), '|') AS others FROM g WHERE len(vs) > 1""")
def u08(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return merging.conflicts(o, ["o_custkey"], ["status", "priority"], F.col("o_orderkey"))


@query("u10_edge_collapse", "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n, max(l_discount) AS confidence FROM lineitem GROUP BY ALL")
def u10(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"), F.max("l_discount").alias("confidence"))


@query("u13_url_dedup", "SELECT regexp_replace(url, '[?#].*$', '') AS canonical, count(*) AS n, min(page_id) AS page_id FROM pages GROUP BY 1")
def u13(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))


@query("n01_upsert", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part""")
def n01(spark, d):
    base = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    incoming = base.where("p_size > 25").withColumn("p_retailprice", F.col("p_retailprice") * 2)
    return merging.upsert(base, incoming, ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("n02_upsert_merge", """SELECT l_suppkey, l_partkey, max(l_discount) AS confidence, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""")
def n02(spark, d):
    """Two batches merged with MAX of one field and a sum of another."""
    l = table(spark, d, "lineitem")
    batches = [l.where(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey", "l_discount", F.lit(1).alias("k")) for f in "AR"]
    return merging.merge_batches(batches, ["l_suppkey", "l_partkey"], [F.max("l_discount").alias("confidence"), F.sum("k").alias("n")])


@query("n03_insert_ignore", "SELECT c_custkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def n03(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return merging.insert_ignore(base, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("origin")), ["k"])


@query("n05_delete_cascade", "SELECT count(*) AS orders_left, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS lines_left FROM orders WHERE o_orderstatus <> 'P'")
def n05(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    left = merging.cascade(o, {"lines": (l, "l_orderkey")}, "o_orderkey", o.where("o_orderstatus = 'P'").select("o_orderkey"))
    return left[""].agg(F.count("*").alias("orders_left")).join(left["lines"].agg(F.count("*").alias("lines_left")))


@query("m06_tax_steps", """SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS base,
 floor(l_extendedprice * (1 - l_discount) * l_tax * 100 + 0.5) / 100 AS tax FROM lineitem""")
def m06(spark, d):
    base = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.half_up(base, 2).alias("base"), scores.half_up(base * F.col("l_tax"), 2).alias("tax"))


@query("m09_present_value", """WITH f AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, round(sum(x / pow(1.08, i)), 2) AS npv FROM f GROUP BY 1""")
def m09(spark, d):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    flows = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / F.pow(F.lit(1.08), i)).alias("x"))
    return flows.groupBy("o_custkey").agg(F.round(F.sum("x"), 2).alias("npv"))


@query("m01_scorecard", """WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT c_custkey, floor((least(100, greatest(0, n * 5)) * 0.35 + least(100, greatest(0, s / 50000)) * 0.45 + least(100, greatest(0, c_acctbal / 100)) * 0.2) * 10 + 0.5) / 10 AS score FROM c)
SELECT c_custkey, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'middle' ELSE 'low' END AS band FROM t""")
def m01(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    zero = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    score = scores.weighted({
        "activity": (scores.clamp(zero("n") * 5, 0.0, 100.0), 0.35), "volume": (scores.clamp(zero("s") / 50000, 0.0, 100.0), 0.45),
        "balance": (scores.clamp(F.col("c_acctbal") / 100, 0.0, 100.0), 0.2),
    })
    t = c.select("c_custkey", score.alias("score"))
    return t.withColumn("band", scores.ladder(F.col("score"), ((60, "high"), (30, "middle")), "low"))

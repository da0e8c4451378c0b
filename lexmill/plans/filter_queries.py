"""Predicates over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, quality
from .base import query, spread, table


@query("f01_visible", "SELECT doc_id FROM documents WHERE lang = 'en' OR (source IS NOT NULL AND source = 'src1')")
def f01(spark, d):
    """English documents are public, the others belong to their source."""
    docs = table(spark, d, "documents")
    return docs.where(filters.visible(F.when(F.col("lang") == "en", "public").otherwise("tenant"), F.col("source"), "src1")).select("doc_id")


@query("f04_facets", "SELECT doc_id FROM documents WHERE lower(coalesce(lang, 'unknown')) IN ('en', 'de') AND lower(coalesce(source, 'general')) IN ('src1', 'src2', 'general')")
def f04(spark, d):
    wanted = {"lang": (F.col("lang"), "unknown", ["EN", " De "]), "source": (F.col("source"), "general", ["SRC1", "src2", "general"]), "year": (F.lit(1), "0", [])}
    return table(spark, d, "documents").where(filters.facets(wanted)).select("doc_id")


@query("f05_metadata_filters", """SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' AND o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1999
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' OR l_returnflag || l_linestatus LIKE '%NO%'))""")
def f05(spark, d):
    """Category prefix, code, range of years, and a tag that equals or resembles the wanted one."""
    tags = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") | F.concat("l_returnflag", "l_linestatus").contains("NO"))
    o = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1-") & (F.col("o_orderstatus") == "F") & filters.between_or_open(F.year("o_orderdate"), 1996, 1999))
    return o.join(tags.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("f06_listing", "SELECT page_id FROM pages WHERE contains(lower(url), 'example.org') AND contains(lower(html), 'lang=\"en\"') AND coalesce(html, '') <> ''")
def f06(spark, d):
    p = table(spark, d, "pages")
    columns = {"url": F.col("url"), "html": F.col("html")}
    return p.where(filters.listing(columns, like={"url": "Example.ORG", "html": 'lang="EN"'}, filled=("html",))).select("page_id")


@query("f07_scope_predicate", "SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%' OR p_name LIKE '%cold%' OR p_brand IN ('Brand#13', 'Brand#5')")
def f07(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").where(filters.any_of([name.contains("bolt"), name.contains("cold")]) | F.col("p_brand").isin("Brand#13", "Brand#5")).select("p_partkey")


@query("f08_topic", "SELECT doc_id FROM documents WHERE coalesce(lang, 'general') = 'de'")
def f08(spark, d):
    return table(spark, d, "documents").where(F.coalesce("lang", F.lit("general")) == "de").select("doc_id")


@query("f09_allowed_hosts", r"""SELECT page_id, url LIKE 'https://%' AND (h = 'example.org' OR h LIKE '%.example.org' OR h = 'example.com' OR h LIKE '%.example.com') AS allowed
FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)""")
def f09(spark, d):
    return table(spark, d, "pages").select("page_id", filters.secure_host(F.col("url"), ("example.org", "example.com")).alias("allowed"))


@query("f12_asks_current", r"SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '\b(now|today|current(ly)?|latest|is)\b') AS current FROM conversations WHERE role = 'user'")
def f12(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).rlike(r"\b(now|today|current(ly)?|latest|is)\b").alias("current"))


@query("f14_missing_feature", """SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'decisions' WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'FURNITURE') AND c_acctbal < 0 THEN 'regulations' END AS missing FROM customer""")
def f14(spark, d):
    """The first feature that a customer's tier lacks: one tier table lookup by expression."""
    has = lambda *tiers: F.col("c_mktsegment").isin(*tiers)
    missing = F.when(~has("AUTOMOBILE", "BUILDING", "MACHINERY"), "decisions").when(~has("AUTOMOBILE", "FURNITURE") & (F.col("c_acctbal") < 0), "regulations")
    return table(spark, d, "customer").select("c_custkey", missing.alias("missing"))


@query("f15_scope", "SELECT event_id FROM (SELECT event_id, user_id, event_type, CASE WHEN value >= 100 THEN 'm1' END AS matter FROM events) WHERE user_id % 5 = 1 AND event_type = 'click' AND matter IS NULL")
def f15(spark, d):
    """Null-safe equality in every part: a scope without a matter sees rows without one."""
    record = {"group": F.col("user_id") % 5, "type": F.col("event_type"), "matter": F.when(F.col("value") >= 100, "m1")}
    return table(spark, d, "events").where(filters.in_scope(record, {"group": 1, "type": "click", "matter": None})).select("event_id")


@query("f16_watch_matches", """WITH rules(rule, lang, keys) AS (VALUES (1, 'en', ['password', 'license']), (2, 'de', ['schlüssel', 'und']), (3, NULL, ['token', 'secret']))
SELECT rule, doc_id FROM rules JOIN documents d ON (rules.lang IS NULL OR rules.lang = d.lang) AND len(list_filter(keys, lambda k: contains(lower(coalesce(text, '')), k))) > 0""")
def f16(spark, d):
    """Few rules of bounded size meet all documents: one predicate for each rule, so no join is needed."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rules = ((1, "en", ("password", "license")), (2, "de", ("schlüssel", "und")), (3, None, ("token", "secret")))
    hits = [F.when(filters.all_of([F.col("lang") == lang] if lang else []) & filters.any_of([low.contains(k) for k in keys]), F.lit(i)) for i, lang, keys in rules]
    return spread(table(spark, d, "documents")).select(F.explode(F.array_compact(F.array(*hits))).alias("rule"), "doc_id")


@query("f17_review_filter", """WITH f AS (SELECT doc_id, n_chars, text, list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END], lambda x: x IS NOT NULL) AS fs FROM documents)
SELECT doc_id, CASE WHEN list_contains(fs, 'short') THEN 'High' ELSE 'Medium' END AS severity FROM f WHERE list_contains(fs, 'shouting') OR contains(lower(text), 'password')""")
def f17(spark, d):
    fs = quality.flags({"short": F.col("n_chars") < 100, "shouting": F.col("text").contains("!!")})
    rows = table(spark, d, "documents").withColumn("fs", fs).where(F.array_contains("fs", "shouting") | F.contains(F.lower("text"), F.lit("password")))
    return rows.select("doc_id", F.when(F.array_contains("fs", "short"), "High").otherwise("Medium").alias("severity"))


@query("f18_answerable_edges", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax >= 0.02 AND l_linestatus = 'F' AND NOT (l_discount > 0.08) AND NOT (l_partkey = l_suppkey)")
def f18(spark, d):
    fs = quality.flags({"weak": F.col("l_discount") > 0.08, "self": F.col("l_partkey") == F.col("l_suppkey")})
    return table(spark, d, "lineitem").where(filters.answerable(F.col("l_tax") >= 0.02, F.col("l_linestatus") == "F", fs)).select("l_orderkey", "l_linenumber", "l_partkey")


_NEXT = """SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst, CAST(left(o_orderpriority, 1) AS INT) AS src_rank, lead(CAST(left(o_orderpriority, 1) AS INT)) OVER w AS dst_rank,
 year(o_orderdate) AS src_year, lead(year(o_orderdate)) OVER w AS dst_year, o_orderstatus, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"""


@query("f19_serving_edges", f"""SELECT src, dst FROM ({_NEXT}) WHERE dst IS NOT NULL AND src <> dst AND o_orderstatus <> 'P' AND o_totalprice >= 50000
AND (o_orderstatus <> 'F' OR NOT (src_rank > dst_rank OR src_year < dst_year))""")
def f19(spark, d):
    """An order's edge to the customer's next dearer order; final ones change their target."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    rank, year = F.left("o_orderpriority", F.lit(1)).cast("int"), F.year("o_orderdate")
    e = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), rank.alias("src_rank"), F.lead(rank).over(w).alias("dst_rank"),
        year.alias("src_year"), F.lead(year).over(w).alias("dst_year"), "o_orderstatus", "o_totalprice",
    )
    edge = {c: F.col(c) for c in ("src", "dst", "src_rank", "dst_rank", "src_year", "dst_year")}
    edge |= {"verified": F.col("o_orderstatus") != "P", "confidence": F.when(F.col("o_totalprice") >= 50000, 0.95).otherwise(0.5)}
    edge |= {"conflict": F.lit(None).cast("string"), "evidence": F.lit("row"), "changes": F.col("o_orderstatus") == "F"}
    return e.where(filters.serving(edge)).select("src", "dst")


@query("f20_any_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), 'license|copyright|password|secret|token|api_key|casino|click here|buy now|http')")
def f20(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return spread(table(spark, d, "documents")).where(low.rlike("license|copyright|password|secret|token|api_key|casino|click here|buy now|http")).select("doc_id")


@query("f21_meaningful_keys", "SELECT p_partkey FROM part WHERE length(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))) >= 4 AND trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) NOT IN ('brand 13', 'unknown')")
def f21(spark, d):
    return table(spark, d, "part").where(filters.meaningful_key(F.col("p_brand"), ("brand 13", "unknown"))).select("p_partkey")


@query("f23_covering_documents", """WITH t AS (SELECT ['the', 'and', 'password', 'tion', 'onen'] AS ts)
SELECT doc_id FROM documents, t WHERE contains(lower(coalesce(text, '')), 'password = ') OR len(list_filter(ts, lambda x: contains(lower(coalesce(text, '')), x))) >= greatest(1, ceil(len(ts) * 0.6))""")
def f23(spark, d):
    ts = F.array(*map(F.lit, ("the", "and", "password", "tion", "onen")))
    return spread(table(spark, d, "documents")).where(filters.covers(F.coalesce("text", F.lit("")), F.lit("password = "), ts)).select("doc_id")


@query("f24_trusted_sources", r"""SELECT page_id FROM (SELECT page_id, url, html, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)
WHERE length(html) / 100 >= 40 AND html LIKE '%<title>%' AND url LIKE 'https://%' AND (h = 'example.org' OR h LIKE '%.example.org' OR h = 'example.net' OR h LIKE '%.example.net')""")
def f24(spark, d):
    p = table(spark, d, "pages")
    allowed = filters.secure_host(F.col("url"), ("example.org", "example.net"))
    return p.where(filters.trusted(F.length("html") / 100, 40.0, F.col("html").contains("<title>"), F.sha2("html", 256), F.col("page_id"), allowed)).select("page_id")

"""Quality checks, evidence, review queues, scores, knowledge hub, work lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import matching, quality
from .base import query, spread, table
from .retrieval import _BM25, _all_scored, _ranked
from .text_queries import _TOKENS


def _docs(spark, d):
    return spread(table(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


_D = "(SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"


@query("q02_missing_text", "SELECT source, count(*) AS n, count(*) FILTER (coalesce(trim(text), '') = '' OR n_chars < 20) AS missing FROM documents WHERE coalesce(lang, '') <> 'es' GROUP BY 1")
def q02(spark, d):
    """Records without text by source; one class of records is excused."""
    rows = table(spark, d, "documents").where(F.coalesce("lang", F.lit("")) != "es")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.coalesce(F.trim("text"), F.lit("")) == "") | (F.col("n_chars") < 20)).alias("missing"))


@query("q03_abnormal_parse", f"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM {_D}), c AS (SELECT doc_id, lang, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[0-9]')) AS numbered, count(*) FILTER (trim(line) = '') AS blank FROM l GROUP BY ALL),
p(lang, least) AS (VALUES ('en', 3), ('de', 2), ('fr', 2))
SELECT doc_id, lines, numbered, blank, lines < least AS too_few FROM c JOIN p USING (lang) WHERE lines < least OR numbered > 0""")
def q03(spark, d):
    """Counts of lines by class against what a profile expects; the profile is one expression."""
    lines = F.split("text", "\n")
    has = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    least = F.when(F.col("lang") == "en", 3).when(F.col("lang").isin("de", "fr"), 2)
    c = _docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("lines"), has("^[0-9]").alias("numbered"), has("^ *$").alias("blank"), least.alias("least"))
    return c.where("least IS NOT NULL AND (lines < least OR numbered > 0)").select("doc_id", "lines", "numbered", "blank", (F.col("lines") < F.col("least")).alias("too_few"))


@query("q04_identity_mismatch", r"""SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS by_url FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> '' AND CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) <> page_id % 100""")
def q04(spark, d):
    """The number that a page's address states against the catalogue's."""
    p = table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("by_url"))
    return p.where("by_url <> page_id % 100")


@query("q05_status_conflict", """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, CASE WHEN f = n THEN 'F' WHEN f = 0 THEN 'O' ELSE 'P' END AS derived FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> CASE WHEN f = n THEN 'F' WHEN f = 0 THEN 'O' ELSE 'P' END""")
def q05(spark, d):
    """The status derived from the parts against the stated one."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    derived = F.when(F.col("f") == F.col("n"), "F").when(F.col("f") == 0, "O").otherwise("P")
    return table(spark, d, "orders").join(l, "o_orderkey").select("o_orderkey", "o_orderstatus", derived.alias("derived")).where("o_orderstatus <> derived")


@query("q07_catalogue_gaps", """WITH c AS (SELECT DISTINCT l_partkey AS k, l_returnflag AS form FROM lineitem) SELECT form, count(*) AS listed, count(*) FILTER (k % 3 = 0 AND p_brand IS NOT NULL) AS held, count(*) FILTER (NOT (k % 3 = 0 AND p_brand IS NOT NULL)) AS missing, form IN ('A', 'R') AS in_scope
FROM c LEFT JOIN part ON p_partkey = k GROUP BY form""")
def q07(spark, d):
    """An outside catalogue against what is held, by form and whether the form is in scope."""
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("form")).distinct()
    held = table(spark, d, "part").where("p_partkey % 3 = 0 AND p_brand IS NOT NULL").select(F.col("p_partkey").alias("k"), F.lit(True).alias("held"))
    h = F.col("held").isNotNull()
    g = c.join(held, "k", "left").groupBy("form").agg(F.count("*").alias("listed"), F.count_if(h).alias("held"), F.count_if(~h).alias("missing"))
    return g.withColumn("in_scope", F.col("form").isin("A", "R"))


@query("q08_what_is_missing", """SELECT * FROM (SELECT 'documents without language' AS item, count(*) AS n FROM documents WHERE lang IS NULL UNION ALL SELECT 'documents without label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'customers without order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'parts without name', count(*) FROM part WHERE coalesce(p_name, '') = '') WHERE n > 0""")
def q08(spark, d):
    """Labelled counts of what lacks; lines of zero are left out."""
    docs = table(spark, d, "documents")
    lacks = {
        "documents without language": docs.where("lang IS NULL"), "documents without label": docs.join(table(spark, d, "labels"), "doc_id", "left_anti"),
        "customers without order": table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "parts without name": table(spark, d, "part").where("coalesce(p_name, '') = ''"),
    }
    each = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, rows in lacks.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.where("n > 0")


@query("q09_number_findings", r"""SELECT s_suppkey, head, raw, 'numbering~' || s_suppkey || '~' || head AS id FROM (SELECT s_suppkey, regexp_extract(left(s_name, 400), '#0*([0-9]+)', 1) AS head, CAST(s_suppkey + s_nationkey % 2 AS VARCHAR) AS raw FROM supplier)
WHERE NOT contains(head, raw) AND NOT contains(raw, head)""")
def q09(spark, d):
    """The number in the head neither holds nor is held by the catalogue's; findings are keyed by content."""
    s = table(spark, d, "supplier").select("s_suppkey", F.regexp_extract(F.left("s_name", F.lit(400)), "#0*([0-9]+)", 1).alias("head"), (F.col("s_suppkey") + F.col("s_nationkey") % 2).cast("string").alias("raw"))
    return s.where(~F.contains("head", "raw") & ~F.contains("raw", "head")).withColumn("id", F.concat_ws("~", F.lit("numbering"), F.col("s_suppkey").cast("string"), "head"))


@query("q15_review_overlay", """WITH i AS (SELECT 'document' AS kind, doc_id AS id FROM documents WHERE n_chars < 100 UNION ALL SELECT 'event', event_id FROM events WHERE event_type = 'error')
SELECT kind, id, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'open' END AS decision FROM i LEFT JOIN labels ON kind = 'document' AND labels.doc_id = id""")
def q15_overlay(spark, d):
    a = table(spark, d, "documents").where("n_chars < 100").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    b = table(spark, d, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    seen = table(spark, d, "labels").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "quality")
    decision = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("open")
    return a.unionByName(b).join(seen, ["kind", "id"], "left").select("kind", "id", decision.alias("decision"))


@query("q16_evidence_contract", "SELECT l_orderkey, bool_and(l_linestatus = 'F' AND l_tax > 0 AND l_discount <= 0.08) AS holds, count(*) AS parts FROM lineitem GROUP BY 1")
def q16(spark, d):
    """Verified only if every part has its hash, its place and its rule."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0) & (F.col("l_discount") <= 0.08)).alias("holds"), F.count("*").alias("parts"))


@query("q17_workflow_issues", """SELECT DISTINCT id, severity FROM (SELECT 'late:' || o_orderkey AS id, 'high' AS severity FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'large:' || o_orderkey, 'medium' FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'late:' || o_orderkey, 'high' FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-06-01')""")
def q17(spark, d):
    """Rules give issues; an issue that several rules give stands once."""
    o = table(spark, d, "orders")
    at = lambda s: F.lit(s).cast("timestamp")
    late = lambda day: (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < at(day))
    issue = lambda test, name, severity: F.when(test, F.struct(F.concat(F.lit(name + ":"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(severity).alias("severity")))
    rules = [issue(late("1996-01-01"), "late", "high"), issue(F.col("o_totalprice") > 250000, "large", "medium"), issue(late("1995-06-01"), "late", "high")]
    return o.select(F.inline(F.array_distinct(F.array_compact(F.array(*rules)))))


@query("q18_regional_match", """WITH c AS (SELECT c_custkey, count(*) AS n, min(s_suppkey) AS target FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7 GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'accepted' ELSE 'ambiguous' END AS state FROM c""")
def q18(spark, d):
    """Accepted only where exactly one candidate fits in all parts."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("k"), "s_suppkey")
    t = matching.unique_targets(s, ["nation", "k"], "s_suppkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("k"))
    one = F.col("n") == 1
    return c.join(t, ["nation", "k"]).select("c_custkey", F.when(one, F.col("target")).alias("target"), F.when(one, "accepted").otherwise("ambiguous").alias("state"))


@query("q19_ground_truth", "SELECT count(*) AS cases, round(avg(contains(html, '<title>')::INT), 6) AS answered, round(avg((html LIKE '%href=%')::INT), 6) AS linked, round(avg((url LIKE '%?%')::INT), 6) AS located FROM pages")
def q19(spark, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, d, "pages").agg(
        F.count("*").alias("cases"), share(F.col("html").contains("<title>")).alias("answered"), share(F.col("html").contains("href=")).alias("linked"), share(F.col("url").contains("?")).alias("located")
    )


@query("t07_bounded_log", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500")
def t07(spark, d):
    """The newest entries of each log stay (the bound is the feature)."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 500").select("event_type", "event_id")


@query("t09_impact_feed", f"""WITH a AS (SELECT DISTINCT conv_id, unnest({_TOKENS}) AS token FROM conversations), e AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS token FROM benchmark),
m AS (SELECT conv_id, item_id, count(*) AS shared FROM a JOIN e USING (token) WHERE length(token) > 3 GROUP BY ALL)
SELECT conv_id, item_id, shared, CASE WHEN shared >= 2 THEN 'critical' ELSE 'notice' END AS level FROM m""")
def t09(spark, d):
    """Alerts, whole conversations, that share words of over three characters with the evidence at hand."""
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("token")).where(F.length("token") > 3).distinct()
    m = words(table(spark, d, "conversations"), "conv_id").join(words(table(spark, d, "benchmark"), "item_id"), "token").groupBy("conv_id", "item_id").agg(F.count("*").alias("shared"))
    return m.withColumn("level", F.when(F.col("shared") >= 2, "critical").otherwise("notice"))


@query("t10_budget_guard", """WITH e AS (SELECT event_id, user_id, ts, TRY_CAST(value AS DECIMAL(18, 6)) AS v FROM events), s AS (SELECT event_id, v, sum(v) OVER w AS spent FROM e WINDOW w AS (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(round(spent, 2) AS DOUBLE) AS spent, spent - v >= 1500 AS refused FROM s""")
def t10(spark, d):
    """A call is refused once the month's spending before it has reached the limit. Amounts are added as decimals
    of six places, so a sum does not depend on the order of its additions."""
    w = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("v", F.col("value").try_cast("decimal(18, 6)"))
    spent = e.select("event_id", "v", F.sum("v").over(w).alias("spent"))
    return spent.select("event_id", F.round("spent", 2).cast("double").alias("spent"), ((F.col("spent") - F.col("v")) >= 1500).alias("refused"))


@query("m02_case_score", """WITH e AS (SELECT user_id, sum(TRY_CAST(round(value * 1000000) AS BIGINT)) AS s, count(TRY_CAST(round(value * 1000000) AS BIGINT)) AS c, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1),
p AS (SELECT *, CASE WHEN c > 0 THEN least(100000000 * c, greatest(-1000000000 * c, s)) ELSE 100000000 END AS v, greatest(c, 1) AS m FROM e),
t AS (SELECT user_id, (7 * v + 7001000000 * m) // (2000000 * m) - 3500 + 2 * least(100, 10 * n) + 50 * k + CASE WHEN k = 5 THEN 100 ELSE 40 END + 50 AS tenths FROM p)
SELECT user_id, CAST(least(1000, greatest(0, tenths)) AS DOUBLE) / 10 AS score FROM t""")
def m02(spark, d):
    """Five weighted parts, held between 0 and 100, halves up to one decimal. All is counted in whole millionths
    and tenths, so no half falls to either side by chance: 0.35 of the mean is 7 / 2,000,000 tenths of the sum of
    millionths by the count; 3,500 tenths are added so that the division has nothing below zero (a mean under -1,000 gives 0 anyway)."""
    value = F.round(F.col("value") * 1000000).try_cast("bigint")
    e = table(spark, d, "events").groupBy("user_id").agg(F.sum(value).alias("s"), F.count(value).alias("c"), F.count("*").alias("n"), F.count_distinct("event_type").alias("k"))
    held = F.when(F.col("c") > 0, F.least(100000000 * F.col("c"), F.greatest(-1000000000 * F.col("c"), "s"))).otherwise(100000000)
    e = e.withColumn("v", held).withColumn("m", F.greatest("c", F.lit(1).cast("bigint")))
    tenths = F.expr("(7 * v + 7001000000 * m) div (2000000 * m)") - 3500 + 2 * F.least(F.lit(100), 10 * F.col("n")) + 50 * F.col("k") + F.when(F.col("k") == 5, 100).otherwise(40) + 50
    return e.select("user_id", (scores.clamp(tenths, 0, 1000).cast("double") / 10).alias("score"))


@query("m03_labels", """WITH s AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) / 4000 AS score, max(c) / count(*)::DOUBLE AS top FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS c FROM orders) GROUP BY 1)
SELECT o_custkey, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 55 THEN 'partial' WHEN score >= 35 THEN 'medium' ELSE 'high risk' END AS label, CASE WHEN n >= 8 AND top >= 0.55 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def m03(spark, d):
    """A ladder of thresholds; confidence from the number of cases and the share of the top outcome."""
    o = table(spark, d, "orders")
    c = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("c"), F.sum("o_totalprice").alias("t"))
    s = c.groupBy("o_custkey").agg(F.sum("c").alias("n"), (F.sum("t") / F.sum("c") / 4000).alias("score"), (F.max("c") / F.sum("c")).alias("top"))
    label = scores.ladder(F.col("score"), ((75, "strong"), (55, "partial"), (35, "medium")), "high risk")
    confidence = F.when((F.col("n") >= 8) & (F.col("top") >= 0.55), "high").when(F.col("n") >= 4, "medium").otherwise("low")
    return s.select("o_custkey", label.alias("label"), confidence.alias("confidence"))


@query("m04_evidence_gaps", """WITH e AS (SELECT user_id, list(DISTINCT event_type) AS have FROM events GROUP BY 1), x AS (SELECT user_id, have, ['click', 'view page', 'purchase', 'sign'] AS want FROM e),
h AS (SELECT user_id, want, list_filter(want, lambda w: len(list_filter(have, lambda s: contains(s, w) OR contains(w, s))) > 0) AS hits FROM x)
SELECT user_id, round(100.0 * len(hits) / 4, 1) AS score, array_to_string(list_filter(want, lambda w: NOT list_contains(hits, w)), ', ') AS gaps FROM h""")
def m04(spark, d):
    """Expected items that some given item holds or is held by. The set is one of five event types."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    want = F.array(*map(F.lit, ("click", "view page", "purchase", "sign")))
    found = lambda w: F.exists("have", lambda s: F.contains(s, w) | F.contains(w, s))
    return e.select("user_id", F.round(100.0 * F.size(F.filter(want, found)) / 4, 1).alias("score"), F.array_join(F.filter(want, lambda w: ~found(w)), ", ").alias("gaps"))


@query("m05_keyword_signals", f"SELECT doc_id, array_to_string(list_filter(['password', 'license', 'than'], lambda k: contains(lower(text), k)), ',') || CASE WHEN n_chars > 5000 THEN '+long' ELSE '' END AS signals FROM {_D}")
def m05(spark, d):
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in ("password", "license", "than")]))
    return _docs(spark, d).select("doc_id", F.concat(F.array_join(found, ","), F.when(F.col("n_chars") > 5000, "+long").otherwise("")).alias("signals"))


@query("m08_extraction_quality", """WITH r AS (SELECT doc_id, (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (coalesce(text, '') <> '')::INT AS filled, least(1, n_chars / 2000.0) AS depth, (text LIKE '%.%')::INT AS sentence, (n_chars BETWEEN 50 AND 20000)::INT AS sane FROM documents),
s AS (SELECT doc_id, filled, least(CASE WHEN filled < 2 THEN 0.4 ELSE 1 END, 0.58 * filled / 3 + 0.17 * depth + 0.15 * coalesce(sentence, 0) + 0.10 * coalesce(sane, 0)) AS q FROM r)
SELECT doc_id, round(100 * q, 1) AS quality, CASE WHEN q >= 0.85 THEN 'high' WHEN q >= 0.6 THEN 'medium' ELSE 'low' END AS label FROM s""")
def m08(spark, d):
    """A blend of coverage, depth, form and plausible size, capped where most fields lack."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    filled = one(F.col("lang").isNotNull()) + one(F.col("source").isNotNull()) + one(F.coalesce("text", F.lit("")) != "")
    blend = 0.58 * filled / 3 + 0.17 * F.least(F.lit(1.0), F.col("n_chars") / 2000.0) + 0.15 * one(F.col("text").contains(".")) + 0.10 * one(F.col("n_chars").between(50, 20000))
    q = F.least(F.when(filled < 2, 0.4).otherwise(1.0), blend)
    return table(spark, d, "documents").select("doc_id", F.round(100 * q, 1).alias("quality"), scores.ladder(q, ((0.85, "high"), (0.6, "medium")), "low").alias("label"))


@query("m12_metric_delta", f"""WITH {_BM25}, g AS (SELECT qid, rank, coalesce(quality, 0) AS g, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, id) AS other FROM r LEFT JOIN labels ON doc_id = id)
SELECT round(avg(b) - avg(a), 6) AS hit_delta, count(*) AS cases FROM (SELECT qid, CAST(max(CASE WHEN rank <= 10 THEN g ELSE 0 END) AS DOUBLE) AS a, CAST(max(CASE WHEN other <= 10 THEN g ELSE 0 END) AS DOUBLE) AS b FROM g GROUP BY qid)""")
def m12(spark, d):
    """A candidate ranking's mean minus the baseline's."""
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    hit = lambda by, name: _ranked(spark, d, 10, by).join(gold, "id", "left").groupBy("qid").agg(F.max(F.coalesce("quality", F.lit(0))).cast("double").alias(name))
    return hit("score", "a").join(hit("matched", "b"), "qid").agg(F.round(F.avg("b") - F.avg("a"), 6).alias("hit_delta"), F.count("*").alias("cases"))


@query("m15_nearly_equal", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - p_retailprice * l_quantity) <= greatest(1, 0.005 * l_extendedprice) AS near FROM lineitem JOIN part ON p_partkey = l_partkey")
def m15(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    gap = F.abs(F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity"))
    return table(spark, d, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", (gap <= F.greatest(F.lit(1.0), 0.005 * F.col("l_extendedprice"))).alias("near"))


@query("d02_source_buckets", "SELECT o_custkey, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderstatus <> 'P') AS eligible, count(*) FILTER (o_orderdate > TIMESTAMP '1998-06-30') AS excluded, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderstatus = 'P') AS uncertain FROM orders GROUP BY 1")
def d02(spark, d):
    there, open_ = F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp"), F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(there & ~open_).alias("eligible"), F.count_if(~there).alias("excluded"), F.count_if(there & open_).alias("uncertain"))


@query("d04_conflicting_variants", "SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS variants, max(l_shipdate) AS preferred, count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS conflict FROM lineitem GROUP BY 1")
def d04(spark, d):
    n = F.count_distinct("l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(n.alias("variants"), F.max("l_shipdate").alias("preferred"), (n > 1).alias("conflict"))


@query("d07_time_travel", """WITH v AS (SELECT l_partkey, l_linenumber, l_shipdate, l_orderkey, l_extendedprice, l_returnflag FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30')
SELECT l_partkey, l_linenumber, arg_max(l_extendedprice, (l_shipdate, l_orderkey)) AS text, max(l_shipdate) AS since, count(*) AS versions FROM v GROUP BY ALL HAVING arg_max(l_returnflag, (l_shipdate, l_orderkey)) <> 'R'""")
def d07(spark, d):
    """The consolidated articles as of a day: each article's latest version by then, unless that one repeals it."""
    at = F.struct("l_shipdate", "l_orderkey")
    v = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-06-30").cast("timestamp"))
    g = v.groupBy("l_partkey", "l_linenumber").agg(
        F.max_by("l_extendedprice", at).alias("text"), F.max("l_shipdate").alias("since"), F.count("*").alias("versions"), F.max_by("l_returnflag", at).alias("kind")
    )
    return g.where("kind <> 'R'").drop("kind")


@query("y01_statistics_subset", f"WITH {_BM25} SELECT qid, count(*) FILTER (round(bm25, 6) >= 18) AS strong, count(*) AS shown FROM r WHERE round(bm25, 6) >= 18 OR rank <= 12 GROUP BY 1")
def y01(spark, d):
    """Rows over the threshold, and the twelve best in any case."""
    best = _ranked(spark, d, 12).select("qid", "id")
    strong = _all_scored(spark, d).where(F.round("bm25", 6) >= 18).select("qid", "id", F.lit(18).alias("bm25"))
    both = best.join(strong, ["qid", "id"], "full_outer")
    return both.groupBy("qid").agg(F.count_if(F.col("bm25") >= 18).alias("strong"), F.count("*").alias("shown"))


@query("y02_outcome_intent", "SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'part') THEN 'partial' WHEN regexp_matches(t, 'all|whole') THEN 'full' WHEN regexp_matches(t, '\\bor\\b') THEN 'win' ELSE 'none' END AS intent FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user')")
def y02(spark, d):
    t = F.lower(F.coalesce("text", F.lit("")))
    intent = F.when(t.rlike("part"), "partial").when(t.rlike("all|whole"), "full").when(t.rlike(r"\bor\b"), "win").otherwise("none")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


@query("y03_focus_tokens", f"SELECT item_id, array_to_string(list_filter({_TOKENS}, lambda x: x NOT IN ('than', 'than', 'onen', 'with')), ' ') AS focus FROM benchmark")
def y03(spark, d):
    """Question words without those that state a ranking; order kept."""
    ts = F.filter(T.tokens(F.coalesce("text", F.lit(""))), lambda x: ~x.isin("than", "onen", "with"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(ts, " ").alias("focus"))


@query("y06_timeline_rows", "SELECT o_orderkey, coalesce(l_linenumber, 0) AS line, coalesce(CAST(l_extendedprice AS VARCHAR), 'summary') <> 'summary' AS has_text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A'")
def y06(spark, d):
    """A record's provisions, or one summary row."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    return table(spark, d, "orders").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).alias("line"), F.col("l_extendedprice").isNotNull().alias("has_text"))


@query("y07_knowledge_fan_out", f"""WITH k AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'forms' END, CASE WHEN lang = 'de' THEN 'treaty' END, CASE WHEN n_chars > 5000 THEN 'guides' END, CASE WHEN contains(text, '!!') THEN 'changes' END], lambda x: x IS NOT NULL)) AS domain FROM {_D})
SELECT domain, doc_id, domain || ':' || doc_id AS id FROM k""")
def y07(spark, d):
    """A record may enter several domains."""
    tests = {"forms": F.lower("text").contains("license"), "treaty": F.col("lang") == "de", "guides": F.col("n_chars") > 5000, "changes": F.col("text").contains("!!")}
    k = _docs(spark, d).select("doc_id", F.explode(quality.flags(tests)).alias("domain"))
    return k.select("domain", "doc_id", F.concat_ws(":", "domain", F.col("doc_id").cast("string")).alias("id"))


@query("y08_evidence_status", f"""SELECT doc_id, CASE WHEN source IS NOT NULL AND sha256(text) <> sha256('') AND lang IS NOT NULL AND n_chars >= 100 THEN 'verified' WHEN text = '' THEN 'missing' ELSE 'review_required' END AS status FROM {_D}""")
def y08(spark, d):
    """Verified needs a source, the digest of a text that is not empty, a place and a known status."""
    digest = F.sha2("text", 256)
    ok = F.col("source").isNotNull() & (digest != F.sha2(F.lit(""), 256)) & F.col("lang").isNotNull() & (F.col("n_chars") >= 100)
    return _docs(spark, d).select("doc_id", F.when(ok, "verified").when(F.col("text") == "", "missing").otherwise("review_required").alias("status"))


@query("y09_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77 LIMIT 1")
def y09(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("y10_count_and_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def y10(spark, d):
    o = table(spark, d, "orders")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.join(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


@query("y11_newest_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def y11(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("y12_latest_row", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY 1")
def y12(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"))


@query("y14_nested_payload", """SELECT c_custkey, '{"id":{"key":' || c_custkey || ',"name":"' || c_name || '"},"account":{"segment":"' || c_mktsegment || '"}}' AS payload FROM customer""")
def y14(spark, d):
    """Flat fields as grouped sections of one JSON object."""
    ident, account = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), F.struct(F.col("c_mktsegment").alias("segment"))
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(ident.alias("id"), account.alias("account"))).alias("payload"))


@query("y17_sampled_pages", """WITH o AS (SELECT o_orderkey, 1 + o_custkey % 40 AS n FROM orders), p AS (SELECT o_orderkey, n, unnest(range(1, n + 1)) AS page FROM o)
SELECT o_orderkey, page FROM p WHERE n <= 14 OR page <= 6 OR page > n - 5 OR page BETWEEN n // 2 - 1 AND n // 2 + 1""")
def y17(spark, d):
    """The first six pages, three in the middle, the last five; all where there are few."""
    p = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 40).alias("n")).select("o_orderkey", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("page"))
    mid = F.floor(F.col("n") / 2)
    return p.where((F.col("n") <= 14) | (F.col("page") <= 6) | (F.col("page") > F.col("n") - 5) | F.col("page").between(mid - 1, mid + 1)).select("o_orderkey", "page")


@query("y21_normalised_arrays", f"SELECT item_id, array_to_string(list_filter({_TOKENS}, lambda x: length(x) >= 6)[1:10], '|') AS items FROM benchmark")
def y21(spark, d):
    """Valid elements only, ten at most (the cap is the feature)."""
    ts = F.filter(T.tokens(F.coalesce("text", F.lit(""))), lambda x: F.length(x) >= 6)
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(ts, 1, 10), "|").alias("items"))


@query("y22_guarded_status", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.08 OR l_partkey = l_suppkey THEN 'review' WHEN l_linestatus = 'F' THEN 'approved' ELSE 'open' END AS status, CASE WHEN l_partkey = l_suppkey THEN 'High' ELSE 'Medium' END AS severity FROM lineitem""")
def y22(spark, d):
    """A suggestion is held back by unsafe flags; the severity follows from them."""
    fs = quality.flags({"weak": F.col("l_discount") > 0.08, "self": F.col("l_partkey") == F.col("l_suppkey")})
    rows = table(spark, d, "lineitem").withColumn("fs", fs)
    status = F.when(F.arrays_overlap("fs", F.array(F.lit("weak"), F.lit("self"))), "review").when(F.col("l_linestatus") == "F", "approved").otherwise("open")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"), F.when(F.array_contains("fs", "self"), "High").otherwise("Medium").alias("severity"))


@query("y27_work_queue", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND len(string_split(coalesce(text, ''), chr(10))) < 2 ORDER BY n_chars DESC, doc_id LIMIT 100")
def y27(spark, d):
    """Unlabelled records with too few lines for their text, longest first."""
    docs = table(spark, d, "documents").where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) < 2)
    return docs.join(table(spark, d, "labels"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")


@query("y34_node_keys", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), regexp_extract(url, '^https?://([^/]+)', 1)) AS key FROM pages")
def y34(spark, d):
    """Identity from the body before that of the metadata."""
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("key"))


@query("y35_trust_flags", "SELECT round(avg((url LIKE 'https://%')::INT), 6) AS official, round(avg((length(html) > 500)::INT), 6) AS body, round(avg((html LIKE '%<title>%')::INT), 6) AS locator FROM pages")
def y35(spark, d):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return table(spark, d, "pages").agg(share(F.col("url").startswith("https://"), "official"), share(F.length("html") > 500, "body"), share(F.col("html").contains("<title>"), "locator"))


@query("y38_gates", """SELECT event_type AS suite, round(avg((value < 190)::INT), 6) AS ratio, avg((value < 190)::INT) >= 0.9 AS gate, bool_and(value < 190) AS all_passed FROM events GROUP BY 1""")
def y38(spark, d):
    ok = F.col("value") < 190
    return table(spark, d, "events").groupBy(F.col("event_type").alias("suite")).agg(F.round(F.avg(ok.cast("int")), 6).alias("ratio"), (F.avg(ok.cast("int")) >= 0.9).alias("gate"), F.bool_and(ok).alias("all_passed"))


@query("y43_workspace_list", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view')) WHERE n <= 20")
def y43(spark, d):
    """A scope's items, newest first, with a capped history."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).withColumn("n", F.row_number().over(w)).where("n <= 20").select("user_id", "event_id")


@query("y44_broken_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW')")
def y44(spark, d):
    """References to what is not there in the same scope."""
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("y49_promoted_evidence", "SELECT d.doc_id, CASE WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN 'verified' ELSE 'draft' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def y49(spark, d):
    v = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, "rejected").when(F.col("quality") == 1, "verified").otherwise("draft").alias("status"))


@query("y51_gap_requests", "WITH r AS (SELECT user_id, event_type, count(*) AS have FROM events GROUP BY ALL) SELECT user_id, event_type AS requirement, 15 - have AS wanted FROM r WHERE have < 15")
def y51(spark, d):
    r = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("requirement")).agg(F.count("*").alias("have"))
    return r.where("have < 15").select("user_id", "requirement", (15 - F.col("have")).alias("wanted"))


@query("y52_sections", "SELECT l_orderkey, l_returnflag AS section, array_to_string(list_transform(list_sort(list(l_linenumber)), lambda x: CAST(x AS VARCHAR)), ',') AS claims FROM lineitem WHERE l_linestatus <> 'R' GROUP BY ALL")
def y52(spark, d):
    """The claims of each section of a document, in order (as many as the document has lines)."""
    g = table(spark, d, "lineitem").where("l_linestatus <> 'R'").groupBy("l_orderkey", F.col("l_returnflag").alias("section")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    return g.select("l_orderkey", "section", F.array_join(F.col("c").cast("array<string>"), ",").alias("claims"))


@query("y55_dashboard_rows", "SELECT upper(p_type) AS label, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def y55(spark, d):
    return table(spark, d, "part").where("p_size > 10").groupBy(F.upper("p_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(5)


@query("y56_source_labels", r"SELECT page_id, CASE WHEN h LIKE '%.example.org' THEN 'Registry' WHEN h LIKE 'blog.%' THEN 'Blog' WHEN h LIKE '%.com' THEN 'Publisher' ELSE 'Other' END AS label FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)")
def y56(spark, d):
    h = T.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.when(h.endswith(".example.org"), "Registry").when(h.startswith("blog."), "Blog").when(h.endswith(".com"), "Publisher").otherwise("Other").alias("label"))


@query("y59_normalised_ids", "SELECT event_id, coalesce(json_extract_string(props, '$.document_id'), json_extract_string(props, '$.id'), json_extract_string(props, '$.k'), 'none') AS id FROM events")
def y59(spark, d):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, d, "events").select("event_id", F.coalesce(get("document_id"), get("id"), get("k"), F.lit("none")).alias("id"))


@query("y60_markers", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[A-Za-z0-9#]+$') THEN '[[' || p_brand || ']]' END AS marker FROM part")
def y60(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_brand").rlike("^[A-Za-z0-9#]+$"), F.concat(F.lit("[["), "p_brand", F.lit("]]"))).alias("marker"))


@query("r07_overlap_score", f"""WITH b AS (SELECT item_id, list_distinct({_TOKENS}) AS ts FROM benchmark), c AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS ts FROM conversations),
s AS (SELECT item_id, conv_id, turn, len(list_intersect(b.ts, c.ts)) AS k, len(b.ts) AS nb, len(c.ts) AS nc FROM b, c)
SELECT item_id, conv_id, turn, round(0.45 * k / (nb + nc - k) + 0.55 * k / nb, 6) AS score FROM s WHERE k > 0""")
def r07(spark, d):
    """0.45 of the Jaccard similarity and 0.55 of the question's coverage, from shared words joined on equality."""
    rows = lambda df, *k: df.select(*k, F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("ts")).select(*k, F.size("ts").alias("n"), F.explode("ts").alias("token"))
    b, c = rows(table(spark, d, "benchmark"), "item_id").withColumnRenamed("n", "nb"), rows(table(spark, d, "conversations"), "conv_id", "turn").withColumnRenamed("n", "nc")
    k = b.join(c, "token").groupBy("item_id", "conv_id", "turn", "nb", "nc").agg(F.count("*").alias("k"))
    return k.select("item_id", "conv_id", "turn", F.round(0.45 * F.col("k") / (F.col("nb") + F.col("nc") - F.col("k")) + 0.55 * F.col("k") / F.col("nb"), 6).alias("score"))


@query("r31_section_snippet", f"""SELECT doc_id, md5(CASE WHEN position('license' IN lower(text)) > 0 THEN substring(text, position('license' IN lower(text)), 200) WHEN position('than' IN lower(text)) > 0 THEN substring(text, greatest(1, position('than' IN lower(text)) - 160), 200) ELSE left(text, 200) END) AS snippet FROM {_D}""")
def r31(spark, d):
    """From the first anchor, else around a keyword, else the head."""
    low = F.lower("text")
    a, k = F.locate("license", low), F.locate("than", low)
    cut = F.when(a > 0, F.substring(F.col("text"), a, F.lit(200))).when(k > 0, F.substring(F.col("text"), F.greatest(F.lit(1), k - 160), F.lit(200))).otherwise(F.left("text", F.lit(200)))
    return _docs(spark, d).select("doc_id", F.md5(cut).alias("snippet"))


@query("r20_vector_blend", f"""WITH {_BM25}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), k AS (SELECT qid, id, round(bm25, 6) AS bm25, max(round(bm25, 6)) OVER (PARTITION BY qid) AS top FROM r WHERE rank <= 10)
SELECT qid, id, round(0.65 * bm25 / top + 0.35 * coalesce(list_cosine_similarity(a.e, b.e), 0), 6) AS score FROM k LEFT JOIN v a ON a.vec_id = qid LEFT JOIN v b ON b.vec_id = id""")
def r20(spark, d):
    """The scaled lexical score blended with the cosine, where vectors are there."""
    v = table(spark, d, "embeddings")
    k = _ranked(spark, d, 10).withColumn("bm25", F.round("bm25", 6)).withColumn("top", F.max(F.round("bm25", 6)).over(Window.partitionBy("qid")))
    k = k.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a")), "qid", "left").join(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b")), "id", "left")
    return k.select("qid", "id", F.round(0.65 * F.col("bm25") / F.col("top") + 0.35 * F.coalesce(scores.cosine(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("score"))

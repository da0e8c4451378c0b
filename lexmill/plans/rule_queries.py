"""Rules as tables, reranking, rates of return, patches, fielded search, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import fielded, patches, rerank, rule_tables
from ..sources.files import scratch
from .base import query, spread, table
from .text_queries import _TOKENS

_WORD = lambda k, c="text": f"nullif(string_split(coalesce({c}, ''), ' ')[{k}], '')"


def _word(k: int):
    return F.nullif(F.get(F.split(F.coalesce("text", F.lit("")), " "), k - 1), F.lit(""))


@query("f16_rule_table", f"""WITH r AS (SELECT item_id AS rule, CASE WHEN item_id % 11 = 0 THEN CAST(item_id AS VARCHAR) END AS resource, CASE WHEN item_id % 7 = 0 THEN lower({_WORD(2)}) END AS citation,
 CASE item_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'general' END AS topic, list_filter([lower({_WORD(3)}), lower({_WORD(5)})], lambda x: x IS NOT NULL) AS keywords FROM benchmark),
d AS (SELECT doc_id AS id, source || '/' || doc_id AS canonical, coalesce(lang, 'general') AS topic, lower(coalesce(text, '')) AS body FROM documents)
SELECT rule, id FROM r JOIN d ON (resource IS NULL OR resource = CAST(id AS VARCHAR) OR coalesce(resource = canonical, FALSE)) AND (r.topic IS NULL OR r.topic = d.topic) AND (citation IS NULL OR contains(body, citation))
 AND (len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(body, k))) > 0)""")
def f16(spark, d):
    """Watch rules from a table, found by one automaton over all documents."""
    k = F.col("item_id")
    topic = F.when(k % 5 == 0, "en").when(k % 5 == 1, "de").when(k % 5 == 2, "general")
    rules = table(spark, d, "benchmark").select(
        k.alias("rule"), F.when(k % 11 == 0, k.cast("string")).alias("resource"), F.when(k % 7 == 0, _word(2)).alias("citation"), topic.alias("topic"), F.array_compact(F.array(_word(3), _word(5))).alias("keywords")
    )
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("canonical"), F.col("lang").alias("topic"), F.col("text").alias("body"))
    return rule_tables.watch_matches(rules, docs)


@query("g19_term_sources", f"""WITH s AS (SELECT item_id AS term, list_filter([lower({_WORD(1)} || ' ' || {_WORD(2)}), lower({_WORD(4)} || ' ' || {_WORD(5)})], lambda x: x IS NOT NULL) AS phrases FROM benchmark),
d AS (SELECT d.doc_id, lower(coalesce(text, '')) AS body, coalesce(quality = 1, FALSE) AS ok FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT term, doc_id, ok, row_number() OVER (PARTITION BY term ORDER BY NOT ok, doc_id) AS n FROM s JOIN d ON len(list_filter(phrases, lambda p: contains(body, p))) > 0)
SELECT s.term, m.doc_id AS id, m.ok AS verified FROM s LEFT JOIN m ON m.term = s.term AND n = 1""")
def g19(spark, d):
    """For each term the first verified document that holds one of its phrases, else the first at all."""
    both = lambda a, b: F.concat(_word(a), F.lit(" "), _word(b))
    seeds = table(spark, d, "benchmark").select(F.col("item_id").alias("term"), F.array_compact(F.array(both(1, 2), both(4, 5))).alias("phrases"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rule_tables.term_sources(seeds, docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), (F.col("quality") == 1).alias("verified"), F.col("text").alias("body")))


@query("r25_expansions", f"""WITH r AS (SELECT doc_id AS place, CASE WHEN doc_id % 3 = 0 THEN 'key' ELSE 'phrase' END AS kind, lower({_WORD(2)}) AS phrase, list_filter([{_WORD(3)}, {_WORD(4)}], lambda x: x IS NOT NULL) AS adds FROM documents WHERE doc_id % 10 = 0),
q AS (SELECT item_id AS qid, lower(coalesce(text, '')) AS t FROM benchmark), f AS (SELECT qid, kind, place, unnest(adds) AS added, generate_subscripts(adds, 1) AS i FROM q JOIN r ON contains(t, phrase)),
g AS (SELECT qid, kind, added, min((place, i)) AS first FROM f GROUP BY ALL)
SELECT qid, kind, added, CAST(row_number() OVER (PARTITION BY qid, kind ORDER BY first, added) AS INT) AS at FROM g""")
def r25(spark, d):
    """Phrases and pinned keys that a rule table adds to a question, in the order of the rules."""
    k = F.col("doc_id")
    rules = table(spark, d, "documents").where(k % 10 == 0).select(
        k.alias("place"), F.when(k % 3 == 0, "key").otherwise("phrase").alias("kind"), F.array_compact(F.array(_word(2))).alias("triggers"), F.array_compact(F.array(_word(3), _word(4))).alias("adds")
    )
    return rule_tables.expansions(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), rules)


_N = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query("r23_context_rerank", f"""WITH r AS MATERIALIZED (SELECT d.doc_id AS id, source AS key, lang AS topic, {_N("coalesce(text, '')")} AS body, coalesce({_N("source")}, '') AS title, {_N("string_split(coalesce(text, ''), chr(10))[1]")} AS prov,
 CASE WHEN source IS NOT NULL THEN 22 ELSE 0 END + CASE WHEN n_chars > 500 THEN 18 ELSE 0 END + CASE WHEN quality = 1 THEN 18 ELSE 0 END + CASE WHEN toxic = 1 THEN -100 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 22 ELSE 0 END AS own FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
q AS MATERIALIZED (SELECT item_id AS qid, CASE WHEN item_id % 40 = 0 THEN 'de' ELSE 'en' END AS topic, list_distinct({_TOKENS}) AS ts, 'src' || (item_id // 20 % 4) AS pin FROM benchmark WHERE item_id % 20 = 0),
s AS MATERIALIZED (SELECT qid, id, coalesce(55.0 * len(list_filter(ts, lambda t: contains(body, t))) / nullif(len(ts), 0), 0) + 13 * len(list_filter(ts, lambda t: contains(title, t))) + 18 * len(list_filter(ts, lambda t: contains(prov, t)))
 + 15 * CASE WHEN contains(body, 'the of') THEN 1 ELSE 0 END + CASE WHEN key = pin THEN 460 ELSE 0 END + CASE WHEN q.topic = r.topic THEN 28 ELSE 0 END + own AS score, body <> '' AS has_text FROM q, r),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS n FROM s),
e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag <> 'R'),
p AS (SELECT DISTINCT qid, id FROM f WHERE n <= 8 UNION SELECT qid, b FROM f JOIN e ON a = id WHERE n <= 4),
g AS (SELECT s.*, coalesce(f.n > 8, FALSE) AS expanded, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 6) DESC, s.id) AS rank FROM p JOIN s ON s.qid = p.qid AND s.id = p.id JOIN f ON f.qid = s.qid AND f.id = s.id)
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank, expanded, coalesce(max(CASE WHEN rank = 1 AND has_text THEN score END) OVER (PARTITION BY qid) >= 55, FALSE) AS answerable FROM g WHERE rank <= 8""")
def r23(spark, d):
    """Two rounds: the best by direct score, and what eligible edges reach from the first four."""
    text = F.coalesce("text", F.lit(""))
    docs = spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "active").when(F.col("toxic") == 1, "revoked")
    own = rerank.own_part(F.col("source").isNotNull(), text.contains("\n"), F.col("n_chars") > 500, status) + F.when((F.col("quality") == 1) & (F.col("toxic") == 1), rerank.REVOKED).otherwise(0.0)
    records = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("key"), F.col("lang").alias("topic"), own.alias("own"), T.normalise(text).alias("body"),
        F.coalesce(T.normalise(F.col("source")), F.lit("")).alias("title"), T.normalise(F.get(F.split(text, "\n"), 0)).alias("provisions"),
    )
    k = F.col("item_id")
    asked = table(spark, d, "benchmark").where(k % 20 == 0).select(
        k.alias("qid"), F.when(k % 40 == 0, "de").otherwise("en").alias("topic"), T.tokens(text).alias("terms"), F.array(F.lit("the of")).alias("phrases"),
        F.array(F.concat(F.lit("src"), F.floor(k / 20 % 4).cast("string"))).alias("pinned"), F.array().cast("array<string>").alias("cited"),
    )
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_returnflag") != "R").alias("eligible"))
    return rerank.rerank(asked, records, edges)


_FLOWS = """y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL), b AS (SELECT k, min(y) AS lo, max(y) AS hi FROM y GROUP BY k),
t AS (SELECT k, lo, unnest(range(lo, hi + 1)) AS y FROM b), c AS (SELECT t.k, t.y - lo AS i, CASE WHEN t.y = lo THEN -2 ELSE 1 END * coalesce(s, 0) AS x FROM t LEFT JOIN y ON y.k = t.k AND y.y = t.y),
f AS (SELECT k, list(x ORDER BY i) AS xs FROM c GROUP BY k)"""
_NPV = lambda r: f"list_sum(list_transform(xs, lambda x, i: x / pow(1 + {r}, i - 1)))"


@query("m09_rate_of_return", f"""WITH RECURSIVE {_FLOWS}, it AS (SELECT k, xs, -0.99::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS n FROM f
 UNION ALL SELECT k, xs, CASE WHEN ({_NPV("(lo + hi) / 2")} > 0) = ({_NPV("-0.99")} > 0) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ({_NPV("(lo + hi) / 2")} > 0) = ({_NPV("-0.99")} > 0) THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM it WHERE n < 60),
r AS (SELECT k, (lo + hi) / 2 AS irr FROM it WHERE n = 60), u AS (SELECT k, i, x, sum(x) OVER (PARTITION BY k ORDER BY i) AS s FROM c),
p AS (SELECT k, arg_min(i - 1 + coalesce((x - s) / nullif(x, 0), 0), i) AS payback FROM u WHERE i > 0 AND s >= 0 GROUP BY k)
SELECT f.k AS o_custkey, round({_NPV("0.12")}, 2) AS npv, CASE WHEN len(xs) > 1 AND {_NPV("-0.99")} * {_NPV("5.0")} < 0 THEN round(irr, 6) END AS irr, round(payback, 6) AS payback FROM f JOIN r USING (k) LEFT JOIN p USING (k)""")
def m09(spark, d):
    """Worth at 12 %, rate of return and break-even of each customer's yearly flows, the first year an outlay. The
    flows are summed by year before they are gathered, so an array is as long as the years."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    g = o.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("y", "s"))).alias("by_year"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    amount = lambda y, i: F.when(i == 0, -2.0).otherwise(1.0) * F.coalesce(F.element_at("by_year", y), F.lit(0.0))
    g = g.select(F.col("k").alias("o_custkey"), F.transform(F.sequence("lo", "hi"), amount).alias("xs"))
    irr = scores.rate_of_return(F.col("xs"))
    return g.select("o_custkey", F.round(scores.discounted(F.col("xs"), F.lit(0.12)), 2).alias("npv"), F.round(irr, 6).alias("irr"), F.round(scores.payback(F.col("xs")), 6).alias("payback"))


_LOG = """l AS (SELECT l_orderkey AS k, 'f' || l_partkey AS finding, CASE WHEN l_linenumber % 2 = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS field, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END) AS value,
  l_linenumber AS pos FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL), a AS (SELECT * FROM l WHERE finding NOT IN (SELECT 'f' || p_partkey FROM part WHERE p_size > 25))"""


@query("q11_patch_undo", f"""WITH {_LOG}, s AS (SELECT k, field, arg_max({{'v': value}}, (pos, finding)).v AS value FROM a GROUP BY ALL), c AS (SELECT k, field, count(DISTINCT coalesce('=' || value, '')) AS n FROM a GROUP BY ALL)
SELECT o_orderkey, CASE WHEN x.k IS NULL THEN o_orderstatus ELSE x.value END AS o_orderstatus, CASE WHEN y.k IS NULL THEN o_orderpriority ELSE y.value END AS o_orderpriority,
 coalesce((SELECT count(*) FROM c WHERE c.k = o_orderkey AND n > 1), 0) AS conflicts FROM orders LEFT JOIN s x ON x.k = o_orderkey AND x.field = 'o_orderstatus' LEFT JOIN s y ON y.k = o_orderkey AND y.field = 'o_orderpriority'""")
def q11(spark, d):
    """Orders as patches leave them once the findings of large parts are undone, with the fields in dispute."""
    l = table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("finding"), F.col("l_orderkey").alias("row"), F.when(F.col("l_linenumber") % 2 == 0, "o_orderstatus").otherwise("o_orderpriority").alias("field"),
        F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("value"), F.col("l_linenumber").alias("at"), F.when(F.col("l_discount") >= 0.05, 0.95).otherwise(0.5).alias("confidence"),
    )
    log = patches.accepted(l, 0.9).groupBy("finding", "row", "field", "at").agg(F.max("value").alias("value"))
    undone = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("finding"))
    log = patches.active(log, undone)
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    disputes = patches.conflicts(log).groupBy(F.col("row").alias("o_orderkey")).agg(F.count("*").alias("conflicts"))
    return patches.state(base, "o_orderkey", log).join(disputes, "o_orderkey", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)).cast("long"))


@query("y25_vote_resolution", """WITH v AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' AND lo = hi AND n >= 2 THEN lo ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus <> 'O' AND lo = hi AND n >= 2 THEN o_orderstatus END AS old FROM orders LEFT JOIN v ON k = o_orderkey""")
def y25(spark, d):
    """Open findings that other sources settle with one voice are closed; each keeps the value it replaced."""
    o = table(spark, d, "orders")
    findings = o.select(F.concat(F.lit("status:"), F.col("o_orderkey").cast("string")).alias("finding"), F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "O", "closed").otherwise("open").alias("state"), F.lit(1).alias("at"))
    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("verdict"))
    base = o.select("o_orderkey", "o_orderstatus")
    log = patches.accepted(patches.vote_proposals(findings, votes, "o_orderstatus"), 0.88)
    old = patches.with_old(base, "o_orderkey", log).select(F.col("row").alias("o_orderkey"), "old")
    return patches.state(base, "o_orderkey", log).join(old, "o_orderkey", "left")


_P = lambda c: f"list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '{fielded.ACCENTED}', '{fielded.PLAIN}'), '[^a-z0-9]+'), lambda w: w <> '')"


@query("r16_fielded_bm25", f"""WITH p AS (SELECT page_id AS id, {_P("html")} AS body, {_P("url")} AS path, {_P("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages),
n AS (SELECT count(*) AS n, avg(len(body) + len(path) + len(title)) AS avgdl FROM p), q AS (SELECT DISTINCT item_id AS qid, unnest({_P("text")}) AS token FROM benchmark),
w AS (SELECT id, unnest(body) AS token, 8.0 AS w FROM p UNION ALL SELECT id, unnest(path), 1.0 FROM p UNION ALL SELECT id, unnest(title), 3.0 FROM p),
tf AS (SELECT id, token, sum(w) AS tf FROM w GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT qid, p.id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(body) + len(path) + len(title)) / avgdl))) AS score, count(*) AS matched FROM q JOIN tf USING (token) JOIN df USING (token) JOIN p ON p.id = tf.id, n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT qid, id, round(score, 6) AS score, matched, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def r16(spark, d):
    """BM25 over weighted counts of a page's text, address and title, from an index that holds a count for each."""
    pages = spread(table(spark, d, "pages")).select(F.col("page_id").alias("id"), F.col("html").alias("body"), F.col("url").alias("path"), T.html_title(F.col("html")).alias("title"))
    index = fielded.build(pages, ["body", "path", "title"], scratch(spark, "fielded-index"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("body"))
    best = fielded.search(spark, index, asked, {"body": 8.0, "path": 1.0, "title": 3.0}, 10)
    return best.select("qid", "id", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("int"))

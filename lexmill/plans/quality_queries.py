"""Corpus checks, gaps, findings, alerts, trust."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import changes, quality, trust
from .base import query, table
from .text_queries import _TOKENS


@query("q01_check_runner", """WITH d AS (SELECT count(*) AS total, count(*) FILTER (coalesce(text, '') = '') AS empty_text, count(*) FILTER (length(text) <> n_chars) AS wrong_size,
 count(*) FILTER (lang IS NULL OR source IS NULL) AS no_origin, count(*) FILTER (n_chars > 20000) AS very_long FROM documents)
SELECT unnest(['empty_text', 'wrong_size', 'no_origin', 'very_long']) AS "check", total, unnest([empty_text, wrong_size, no_origin, very_long]) AS failed,
 round(unnest([empty_text, wrong_size, no_origin, very_long]) / total, 6) AS ratio FROM d""")
def q01(spark, d):
    return quality.run_checks(table(spark, d, "documents"), {
        "empty_text": F.coalesce("text", F.lit("")) == "", "wrong_size": F.length("text") != F.col("n_chars"),
        "no_origin": F.col("lang").isNull() | F.col("source").isNull(), "very_long": F.col("n_chars") > 20000,
    })


@query("q06_numbering_gaps", """WITH g AS (SELECT o_orderpriority, year(o_orderdate) AS y, min(o_orderkey) AS low, max(o_orderkey) AS high, count(DISTINCT o_orderkey) AS have FROM orders GROUP BY ALL)
SELECT o_orderpriority, y, low, high, have, high - low + 1 - have AS n_missing FROM g WHERE have >= 8 AND have >= 0.01 * (high - low + 1)""")
def q06(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return quality.gaps(o, ["o_orderpriority", "y"], "o_orderkey", density=0.01)


@query("u03_missing_runs", """WITH n AS (SELECT o_orderstatus, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS nx, o_orderpriority FROM orders)
SELECT o_orderstatus, o_orderpriority, o_orderkey + 1 AS first, nx - 1 AS last FROM n WHERE nx > o_orderkey + 1""")
def u03(spark, d):
    return quality.missing_runs(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("q12_findings", """WITH f AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN text LIKE '%***%' THEN 'symbols' END], lambda x: x IS NOT NULL) AS fs FROM documents)
SELECT doc_id, unnest(fs) AS flag FROM f""")
def q12(spark, d):
    fs = quality.flags({"short": F.col("n_chars") < 100, "shouting": F.col("text").contains("!!"), "symbols": F.col("text").contains("***")})
    return table(spark, d, "documents").select("doc_id", F.explode(fs).alias("flag"))


@query("m16_votes", """WITH v AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS agree, count(*) FILTER (l_returnflag = 'R') AS disagree FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN disagree > 0 THEN NULL WHEN agree >= 4 THEN 0.96::DOUBLE WHEN agree = 3 THEN 0.94 WHEN agree = 2 THEN 0.88 WHEN agree = 1 THEN 0.62 END AS confidence FROM v""")
def m16(spark, d):
    flag = F.col("l_returnflag")
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(flag == "A").alias("agree"), F.count_if(flag == "R").alias("disagree"))
    return v.select("l_orderkey", quality.vote(F.col("agree"), F.col("disagree")).alias("confidence"))


@query("q10_finding_queue", """WITH old AS (SELECT doc_id, 'open' AS state FROM labels WHERE quality = 0), new AS (SELECT doc_id FROM documents WHERE text LIKE '%***%' OR text LIKE '%!!%')
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN new.doc_id IS NULL THEN 'closed' ELSE 'kept' END AS state FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def q10(spark, d):
    old = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("was"))
    new = table(spark, d, "documents").where("text LIKE '%***%' OR text LIKE '%!!%'").select("doc_id", F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "closed").otherwise("kept")
    return old.join(new, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("q11_patch_overlay", """WITH p AS (SELECT l_orderkey AS k, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(p.v, o_orderstatus) AS status FROM orders LEFT JOIN p ON p.k = o_orderkey""")
def q11(spark, d):
    """The latest patch of a row wins over its base value."""
    patch = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("v")
    )
    return table(spark, d, "orders").join(patch, "o_orderkey", "left").select("o_orderkey", F.coalesce("v", "o_orderstatus").alias("status"))


@query("q14_trust_decision", """WITH s AS (SELECT d.doc_id, CASE WHEN length(coalesce(text, '')) >= 200 THEN 25 ELSE 0 END + CASE WHEN quality = 1 THEN 35 ELSE 0 END + CASE WHEN toxic = 0 THEN 25 ELSE 0 END
 + CASE WHEN lang = 'en' THEN 15 ELSE 0 END AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 85 THEN 'trusted' WHEN score >= 40 THEN 'review' ELSE 'abstain' END AS level FROM s""")
def q14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    score = quality.trust_score({
        "long": (F.length(F.coalesce("text", F.lit(""))) >= 200, 25.0), "good": (F.col("quality") == 1, 35.0),
        "clean": (F.col("toxic") == 0, 25.0), "main": (F.col("lang") == "en", 15.0),
    })
    return rows.select("doc_id", score.alias("score")).withColumn("level", scores.ladder(F.col("score"), ((85, "trusted"), (40, "review")), "abstain"))


@query("t01_fingerprints", """WITH u AS (SELECT DISTINCT user_id, md5(event_type || '~' || event_id) AS h FROM events)
SELECT user_id, count(*) AS n, CAST(CAST(sum(CAST('0x' || substring(h, 1, 8) AS BIGINT)) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(sum(CAST('0x' || substring(h, 9, 8) AS BIGINT)) AS BIGINT) AS VARCHAR) AS digest FROM u GROUP BY 1""")
def t01(spark, d):
    return changes.fingerprint(table(spark, d, "events"), ["user_id"], F.concat_ws("~", "event_type", "event_id"))


@query("t02_change_alerts", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL),
b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS before FROM s)
SELECT user_id, day, state, before FROM b WHERE before <> state""")
def t02(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return changes.alerts(s, ["user_id"], "day", "state")


@query("t05_retry_backoff", """WITH a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events)
SELECT event_id, CAST(least(86400, 30 * pow(2, greatest(attempt - 1, 0))) AS BIGINT) AS delay, CASE WHEN attempt > 10 THEN 'dead' ELSE 'retry' END AS state FROM a""")
def t05(spark, d):
    a = table(spark, d, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return a.select("event_id", scores.backoff_seconds(F.col("attempt"), 30).alias("delay"), F.when(F.col("attempt") > 10, "dead").otherwise("retry").alias("state"))


@query("t06_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1")
def t06(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


@query("k09_quarantine", """SELECT CASE WHEN coalesce(text, '') = '' THEN 'no text' WHEN lang IS NULL THEN 'no language' WHEN n_chars < 20 THEN 'too short' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def k09(spark, d):
    reason = F.when(F.coalesce("text", F.lit("")) == "", "no text").when(F.col("lang").isNull(), "no language").when(F.col("n_chars") < 20, "too short")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("k11_manifest", """SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, min(sha256(coalesce(text, ''))) AS least_hash, max(sha256(coalesce(text, ''))) AS greatest_hash FROM documents GROUP BY 1""")
def k11(spark, d):
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min(h).alias("least_hash"), F.max(h).alias("greatest_hash")
    )


@query("q15_claim_support", f"""WITH c AS (SELECT conv_id, turn, unnest(list_distinct({_TOKENS})) AS token, len(list_distinct({_TOKENS})) AS n FROM conversations WHERE role = 'assistant'),
s AS (SELECT item_id AS source_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark),
p AS (SELECT conv_id, turn, n, source_id, count(*) AS common FROM c JOIN s USING (token) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY common DESC, source_id) AS k FROM p)
SELECT conv_id, turn, source_id, round(common / n, 6) AS support, common / n >= 0.22 AS supported FROM b WHERE k = 1""")
def q15(spark, d):
    """The passage that supports each assistant turn best."""
    claims = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body"))
    sources = table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("body"))
    best = trust.support(claims, sources, ["conv_id", "turn"])
    return best.select("conv_id", "turn", "source_id", F.round("support", 6).alias("support"), (F.col("support") >= trust.LEAST_SUPPORT).alias("supported"))

"""Rules in full where an earlier query keeps a part of them: gates, match cascades, manifests, scores, readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..functions import text as T
from ..operators import hybrid_scores, postings, trust
from .base import query, spread, table
from .retrieval import _index
from .text_queries import _TOKENS

_STRONG = {"secret": r"\b(?:password|secret|token)\b", "code": r"[0-9]{4}", "long": r"\w{14}"}
_WEAK = {"law": r"\b(?:license|article)\b", "percent": "%"}
_AGAINST = {"shout": "!!", "mail": "@"}
_HAS = lambda p: f"regexp_matches(t, '{p}')"
_LIST = lambda table_: "list_filter([" + ", ".join(f"CASE WHEN {_HAS(p)} THEN '{n}' END" for n, p in table_.items()) + "], lambda x: x IS NOT NULL)"


@query("f11_domain_signals", f"""WITH d AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS t FROM documents), s AS (SELECT doc_id, t, {_LIST(_STRONG)} AS s, {_LIST(_WEAK)} AS w, {_LIST(_AGAINST)} AS a FROM d),
c AS (SELECT *, 35 * len(s) + 8 * len(w) - 35 * len(a) AS score FROM s)
SELECT doc_id, length(t) >= 3 AND len(s) > 0 AND score >= 25 AND NOT (len(a) > 0 AND NOT list_contains(s, 'secret')) AS in_scope, CAST(greatest(0, least(100, score)) AS INT) AS score, array_to_string(list_concat(s, w), ' ') AS signals, array_to_string(a, ' ') AS exclusions FROM c""")
def f11(spark, d):
    """Weighted signals, exclusions, an override, and the reasons."""
    g = gates.domain_gate(F.col("text"), _STRONG, _WEAK, _AGAINST, ("secret",))
    rows = spread(table(spark, d, "documents")).select("doc_id", g.alias("g"))
    return rows.select("doc_id", "g.in_scope", "g.score", F.array_join("g.signals", " ").alias("signals"), F.array_join("g.exclusions", " ").alias("exclusions"))


@query("j14_three_tiers", """WITH c AS (SELECT o_orderkey AS k, o_custkey AS n, year(o_orderdate) AS y, o_orderpriority AS t, o_orderkey % 3 = 0 AS plain, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE NULL END AS id FROM orders),
r AS (SELECT o_orderkey AS rid, 'x' || o_orderkey AS id, o_custkey AS n, year(o_orderdate) + 1 AS y, o_orderpriority AS t FROM orders), a AS (SELECT n, y, min(rid) AS rid FROM r GROUP BY ALL), b AS (SELECT t, n, y - 1 AS y, min(rid) AS rid FROM r GROUP BY ALL)
SELECT k AS o_orderkey, coalesce(r.rid, a.rid, b.rid) AS target, CASE WHEN r.rid IS NOT NULL THEN 'key' WHEN a.rid IS NOT NULL THEN 'number and year' WHEN b.rid IS NOT NULL THEN 'type, number, year' ELSE 'none' END AS tier
FROM c LEFT JOIN r ON r.id = c.id LEFT JOIN a ON a.n = c.n AND a.y = c.y LEFT JOIN b ON b.t = c.t AND b.n = c.n AND b.y = c.y AND c.plain""")
def j14(spark, d):
    """By key, else by number and year, else, for plain numbers alone, by type, number and year: the first hit wins."""
    o = table(spark, d, "orders")
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    named = F.concat(F.lit("x"), k.cast("string"))
    ask = o.select(k, F.col("o_custkey").alias("n"), y.alias("y"), F.col("o_orderpriority").alias("t"), (k % 3 == 0).alias("plain"), F.when(k % 5 == 0, named).alias("id"))
    known = o.select(k.alias("rid"), named.alias("id"), F.col("o_custkey").alias("n"), (y + 1).alias("y"), F.col("o_orderpriority").alias("t"))
    by_number = known.groupBy("n", "y").agg(F.min("rid").alias("two"))
    by_type = known.groupBy("t", "n", (F.col("y") - 1).alias("y")).agg(F.min("rid").alias("three")).withColumn("plain", F.lit(True))
    m = ask.join(known.select("id", F.col("rid").alias("one")), "id", "left").join(by_number, ["n", "y"], "left").join(by_type, ["t", "n", "y", "plain"], "left")
    tier = F.when(F.col("one").isNotNull(), "key").when(F.col("two").isNotNull(), "number and year").when(F.col("three").isNotNull(), "type, number, year").otherwise("none")
    return m.select("o_orderkey", F.coalesce("one", "two", "three").alias("target"), tier.alias("tier"))


@query("j25_json_dependencies", """WITH j AS (SELECT o_orderkey AS id, o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN [o_orderkey - 1] WHEN 2 THEN [o_orderkey - 1, o_orderkey - 2] ELSE [o_orderkey - 2, 99999999] END AS deps FROM orders),
x AS (SELECT id, unnest(deps) AS dep FROM j), b AS (SELECT x.id, count(*) FILTER (coalesce(p.o_orderstatus, '') <> 'F') AS open FROM x LEFT JOIN j p ON p.id = dep GROUP BY x.id)
SELECT j.id AS o_orderkey, coalesce(open, 0) = 0 AS ready, coalesce(open, 0) AS missing FROM j LEFT JOIN b USING (id)""")
def j25(spark, d):
    """A job is ready if every job of its JSON array of prerequisites is there and done."""
    k = F.col("o_orderkey")
    some = lambda *xs: F.concat(F.lit("["), F.concat_ws(", ", *[x.cast("string") for x in xs]), F.lit("]"))
    deps = F.when(k % 4 == 0, "[]").when(k % 4 == 1, some(k - 1)).when(k % 4 == 2, some(k - 1, k - 2)).otherwise(some(k - 2, F.lit(99_999_999)))
    jobs = table(spark, d, "orders").select(k, "o_orderstatus", deps.alias("deps"))
    asked = jobs.select("o_orderkey", F.explode(F.array_distinct(F.from_json("deps", "array<bigint>"))).alias("dep"))
    done = jobs.where("o_orderstatus = 'F'").select(k.alias("dep"), F.lit(True).alias("done"))
    open_ = asked.join(done, "dep", "left").groupBy("o_orderkey").agg(F.count_if(F.col("done").isNull()).alias("missing"))
    rows = jobs.select("o_orderkey").join(open_, "o_orderkey", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return rows.select("o_orderkey", (F.col("missing") == 0).alias("ready"), F.col("missing").cast("long"))


@query("k09_routed", """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'missing text' WHEN coalesce(lang, '') = '' THEN 'missing lang' WHEN coalesce(source, '') = '' AND lang <> 'en' THEN 'missing source' ELSE 'kept' END AS sink FROM documents""")
def k09(spark, d):
    """Every row with the sink it goes to: kept, or quarantine with its reason; one language needs no source."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sink = F.when(blank("text"), "missing text").when(blank("lang"), "missing lang").when(blank("source") & (F.col("lang") != "en"), "missing source").otherwise("kept")
    return table(spark, d, "documents").select("doc_id", sink.alias("sink"))


@query("k11_corpus_manifest", """WITH h AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS h, n_chars FROM documents), s AS (SELECT source, sha256(string_agg(doc_id || ':' || h, chr(10) ORDER BY doc_id)) AS part, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, doc_id // 1000 AS slab FROM h) GROUP BY source, slab)
SELECT source, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(chars) AS BIGINT) AS chars, sha256(string_agg(part, chr(10) ORDER BY part)) AS corpus_hash FROM s GROUP BY source""")
def k11(spark, d):
    """A hash of each source's corpus: of its slabs of a thousand ids, whose hashes are those of their texts in order,
    so no list is longer than a slab."""
    h = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("slab"), "n_chars", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"])
    s = h.groupBy("source", "slab").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("part"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return s.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "\n"), 256).alias("corpus_hash"))


@query("q13_validated_answers", f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id * 7 + turn) % 250 AS sid, turn % 5 = 0 AS bad FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, sid, bad, list_distinct({_TOKENS}) AS ts FROM c), b AS (SELECT item_id, item_id % 3 <> 0 AS ok, list_distinct({_TOKENS}) AS bs FROM benchmark),
p AS (SELECT conv_id, bad, item_id IS NULL OR NOT ok AS unknown, coalesce(ok, FALSE) AND coalesce(len(list_intersect(ts, bs)) / nullif(len(ts), 0), 0) >= 0.22 AS supported FROM k LEFT JOIN b ON item_id = sid),
g AS (SELECT conv_id, count(*) AS claims, count(*) AS cited, count(*) FILTER (unknown) AS unknown, count(*) FILTER (bad) AS malformed, count(*) FILTER (supported) AS supported FROM p GROUP BY 1)
SELECT conv_id AS answer_id, claims, cited, unknown, malformed, supported, round(supported / claims, 6) AS coverage, unknown = 0 AND malformed = 0 AND supported / claims >= 0.8 AS valid FROM g""")
def q13(spark, d):
    """Answers are conversations, claims their turns with a marker of a source: which hold."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    sid = ((F.col("conv_id") * 7 + F.col("turn")) % 250).cast("string")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" [S:"), sid, F.lit("]"), F.when(F.col("turn") % 5 == 0, " [S oops]").otherwise(""))
    claims = c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_id"), body.alias("body"))
    sources = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("body"), (F.col("item_id") % 3 != 0).alias("eligible"))
    long = [F.col(x).cast("long") for x in ("claims", "cited", "unknown", "malformed", "supported")]
    return trust.validate(claims, sources).select("answer_id", *long, F.round("coverage", 6).alias("coverage"), "valid")


@query("x17_whole_sentences")
def x17(spark, d):
    """Sentences that spare abbreviations, by number; the pattern looks behind, so SQL has no twin: see the tests."""
    s = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(gates.sentences(F.col("text"))).alias("sentence_no", "s"))
    return s.select("doc_id", "sentence_no", F.length("s").alias("n_chars"), F.md5("s").alias("sentence_md5"))


_MONTH = "['januari', 'februari', 'maret', 'april', 'mei', 'juni', 'juli', 'agustus', 'september', 'oktober', 'november', 'desember'][month({})]"


@query("x40_periods_in_text", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) - 10 END AS "start", CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS "end" FROM orders""")
def x40(spark, d):
    """Periods read from sentences; a start without a year inherits or lies in the year before; impossible days are none."""
    end = F.to_date("o_orderdate")
    start, names = F.date_sub(end, 10), F.array(*map(F.lit, gates.MONTHS))
    day = lambda x: F.concat_ws(" ", F.dayofmonth(x).cast("string"), F.initcap(F.element_at(names, F.month(x))))
    k = F.col("o_orderkey")
    first = F.when(k % 7 == 0, "31 Februari").when((k % 2 == 0) | (F.year(start) == F.year(end) - 1) & (k % 3 > 0), day(start)).otherwise(F.concat_ws(" ", day(start), F.year(start).cast("string")))
    said = F.concat(F.lit("Kurs berlaku  untuk tanggal "), first, F.lit(" sampai dengan "), day(end), F.lit(" "), F.year(end).cast("string"), F.lit(", 5 Mei 1999."))
    return table(spark, d, "orders").select("o_orderkey", gates.period_in(said).alias("p")).select("o_orderkey", "p.start", "p.end")


@query("x41_rate_rows", """WITH c AS (SELECT c_custkey AS k, round(abs(c_acctbal), 2) AS v, 'C' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'X' AS code FROM customer)
SELECT k AS c_custkey, 1 AS place, code, 'Dolar Satu' AS name, v AS value, 1.0::DOUBLE AS per FROM c UNION ALL SELECT k, 2, 'ZZZ', 'Yen', v, 100.0 FROM c""")
def x41(spark, d):
    """Rows of a rate table in either number convention; a repeated code and one without a value do not count."""
    k, v = F.col("c_custkey"), F.round(F.abs("c_acctbal"), 2)
    english = F.format_number(v, 2)
    local = F.translate(english, ",.", ".,")
    code = F.concat(F.lit("c"), F.char(65 + k % 26), F.lit("x"))
    said = F.concat(
        F.lit("Tabel: 1. "), F.when(k % 2 == 0, english).otherwise(local), F.lit("  Dolar Satu ("), code, F.lit(") per 1; 2. "), F.when(k % 3 == 0, english).otherwise(local),
        F.lit("- Yen (ZZZ) per 100\n3. 7,00 Lagi ("), F.upper(code), F.lit(")"),
    )
    rows = spread(table(spark, d, "customer")).select("c_custkey", F.regexp_replace(said, "- Yen", " Yen").alias("t"))
    # the outer form, as Spark would read the rows two more times to leave out texts without any before the inner one
    return rows.select("c_custkey", F.inline_outer(gates.rate_rows(F.col("t")))).where("place IS NOT NULL")


_Q = f"q AS MATERIALIZED (SELECT item_id AS qid, lower(coalesce(text, '')) AS said, {_TOKENS} AS ts, list_filter(list_distinct({_TOKENS}), lambda x: length(x) > 4) AS fs FROM benchmark WHERE item_id % 20 = 0)"
_COS = f"""d AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS ts, lower(coalesce(text, '')) AS body, coalesce(lower(source), '') AS source, coalesce(lower(lang), '') AS lang, lower(left(coalesce(text, ''), 60)) AS head, n_chars FROM documents),
qt AS (SELECT qid, token, count(*) AS c FROM (SELECT qid, unnest(ts) AS token FROM q) GROUP BY ALL), dt AS MATERIALIZED (SELECT id, token, count(*) AS c FROM (SELECT id, unnest(ts) AS token FROM d) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dt GROUP BY 1), qn AS (SELECT qid, sqrt(sum(c * c)) AS n FROM qt GROUP BY 1),
cs AS MATERIALIZED (SELECT qid, id, sum(qt.c * dt.c) / any_value(qn.n * dn.n) AS cosine FROM qt JOIN dt USING (token) JOIN qn USING (qid) JOIN dn USING (id) GROUP BY ALL),
h AS MATERIALIZED (SELECT qid, id, said, head, n_chars, lang, len(fs) AS n, len(list_filter(fs, lambda t: contains(body, t))) AS b, len(list_filter(fs, lambda t: contains(source, t))) AS s, len(list_filter(fs, lambda t: contains(lang, t))) AS l,
 len(list_filter(fs, lambda t: contains(head, t))) AS t, coalesce(cosine, 0) AS cosine FROM q JOIN d ON TRUE LEFT JOIN cs USING (qid, id))"""
_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM x) SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"


def _scored_pairs(spark, d):
    """The pairs of the questions and documents with their counts, cosine and texts."""
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("body"))
    focus = asked.select("qid", F.explode(F.filter(F.array_distinct(T.tokens(F.col("body"))), lambda x: F.length(x) > 4)).alias("term"))
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), low("text").alias("body"), low("source").alias("party"), low("lang").alias("issue"), F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(60))).alias("title"), "n_chars")
    fields = ["body", "party", "issue", "title"]
    cosines = postings.cosine_top(spark, _index(spark, d), asked, 1 << 30).withColumnRenamed("score", "cosine")
    pairs = hybrid_scores.pairs(cosines, hybrid_scores.field_hits(focus, docs, fields), focus, fields)
    return pairs.join(asked.select("qid", F.lower("body").alias("said")), "qid").join(docs.select("id", "title", "issue", "n_chars"), "id")


def _eight(rows, score):
    from ..operators import ranking

    return ranking.top(rows.withColumn("score", F.round(score, 6)), "score", 8).select("qid", "id", "score", F.col("rank").cast("int"))


@query("r08_decision_scores", f"""WITH {_Q}, {_COS}, y AS (SELECT qid, id, 42.0 * cosine + CASE WHEN n > 0 THEN 30.0 * b / n + CASE WHEN s > 0 THEN least(34, 22 + 8 * s) ELSE 0 END + CASE WHEN id % 50 = qid % 50 THEN 28 ELSE 0 END + CASE WHEN l > 0 THEN least(18, 8 + 5 * l) ELSE 0 END ELSE 0 END AS v, n, b FROM h WHERE cosine > 0 OR b + s + l + t > 0),
x AS (SELECT qid, id, greatest(0, least(100, v * CASE WHEN n > 0 AND b = 0 THEN 0.35 ELSE 1 END + CASE WHEN id % 9 = 0 THEN CASE WHEN n > 0 THEN 8 ELSE 20 END ELSE 0 END)) AS score FROM y), {_TOP}""")
def r08(spark, d):
    """The eight best by the score of decisions: parties are sources, numbers the last digits, outcomes every ninth."""
    n = lambda c: F.col(f"n_{c}")
    number = (F.col("id") % 50 == F.col("qid") % 50).cast("int")
    score = hybrid_scores.decision_score(F.col("cosine"), F.col("n_focus"), n("body"), n("party"), number, n("issue"), F.col("id") % 9 == 0)
    return _eight(_scored_pairs(spark, d), score)


@query("r09_regulation_scores", f"""WITH {_Q}, {_COS}, y AS (SELECT *, 38.0 * cosine + CASE WHEN n > 0 THEN 26.0 * b / n + CASE WHEN t > 0 THEN least(28, 12 + 5 * t) ELSE 0 END ELSE 0 END AS v FROM h WHERE cosine > 0 OR b + s + l + t > 0),
x AS (SELECT qid, id, greatest(0, least(100, v * CASE WHEN n > 0 AND b = 0 THEN 0.4 ELSE 1 END + CASE WHEN lang = 'en' THEN 14 ELSE 0 END + CASE WHEN contains(head, said) OR contains(said, left(head, 24)) THEN 18 ELSE 0 END + CASE WHEN id % 50 = qid % 50 THEN 16 ELSE 0 END
 + 0.65 * CASE id % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 2 END + least(8, greatest(0, (id % 100 - 70) / 4.0)) + CASE WHEN qid % 40 = 0 AND contains(head, 'the') THEN 8 ELSE 0 END + CASE WHEN qid % 60 = 0 AND n_chars > 1000 THEN 6 ELSE 0 END)) AS score FROM y), {_TOP}""")
def r09(spark, d):
    """The eight best by the score of regulations: titles are heads of texts, the rest follows from ids and sizes."""
    k, q = F.col("id"), F.col("qid")
    n = lambda c: F.col(f"n_{c}")
    named = F.contains("title", "said") | F.contains(F.col("said"), F.left("title", F.lit(24)))
    authority = F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 7.0).otherwise(2.0)
    status, source = (q % 40 == 0) & F.contains("title", F.lit("the")), (q % 60 == 0) & (F.col("n_chars") > 1000)
    score = hybrid_scores.regulation_score(F.col("cosine"), F.col("n_focus"), n("body"), n("title"), F.col("issue") == "en", named, k % 50 == q % 50, authority, (k % 100).cast("double"), status, source)
    return _eight(_scored_pairs(spark, d), score)

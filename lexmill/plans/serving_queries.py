"""Further rankings, structure, references, evidence, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks, citations, scores, structure
from ..functions import text as T
from ..operators import comparables, filters, matching, postings
from ..sources import files
from .base import query, spread, table
from .retrieval import _BM25, _index, _inputs, _ranked
from .text_queries import _TOKENS

_D = "(SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"


def _docs(spark, d):
    return spread(table(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


@query("r06_log_weighted", f"""WITH d AS (SELECT id, token, count(*) AS d FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL), q AS (SELECT qid, token, count(*) AS q FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(d * d)) AS dn FROM d GROUP BY id), qn AS (SELECT qid, sqrt(sum(q * q)) AS qn FROM q GROUP BY qid),
t AS (SELECT qid, id, round(sum(q * (1 + ln(1 + d)) / dn * (1 / qn)) * 100, 6) AS score FROM d JOIN q USING (token) JOIN dn USING (id) JOIN qn USING (qid) GROUP BY ALL)
SELECT qid, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 10""")
def r06(spark, d):
    """Question counts times 1 + ln(1 + tf) over the norms, in per cent."""
    best = postings.cosine_top(spark, _index(spark, d), _inputs(spark, d)[1], 10, logarithmic=True)
    return best.select("qid", "id", F.round(F.round("score", 6), 4).alias("score"), F.col("rank").cast("long"))


@query("r18_over_fetched", f"WITH {_BM25} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM r JOIN documents ON doc_id = id WHERE rank <= 80 AND lang = 'en' QUALIFY place <= 10")
def r18(spark, d):
    """Eight times the limit is fetched, then filtered, then cut (the reference order of limit and filter)."""
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    rows = _ranked(spark, d, 80).join(docs, "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return rows.select("qid", "id", place.cast("long").alias("place")).where("place <= 10")


@query("r19_provision_scores", f"""WITH {_BM25}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid)
SELECT qid, id, round(round(bm25, 6) * (0.4 + 1.6 * pow(matched / nq, 2)), 6) AS score, nq - matched AS missing FROM r JOIN nq USING (qid) WHERE rank <= 20""")
def r19(spark, d):
    """A unit's score by its coverage of the question, squared."""
    nq = _inputs(spark, d)[1].select("qid", F.size(F.array_distinct(T.tokens(F.col("body")))).alias("nq"))
    rows = _ranked(spark, d, 20).join(nq, "qid")
    return rows.select("qid", "id", F.round(F.round("bm25", 6) * (0.4 + 1.6 * F.pow(F.col("matched") / F.col("nq"), 2)), 6).alias("score"), (F.col("nq") - F.col("matched")).alias("missing"))


@query("r13_compact_projection", """WITH f AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id, text) AS first FROM conversations WHERE coalesce(text, '') <> ''),
k AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM f WHERE turn = first)
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS body, count(*) AS parts FROM k WHERE used <= 1500 GROUP BY 1""")
def r13(spark, d):
    """A record's distinct fragments in order while they fit the budget (the budget is the feature)."""
    c = table(spark, d, "conversations").where("coalesce(text, '') <> ''")
    first = c.groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    k = first.withColumn("used", F.sum(F.length("text") + 1).over(w)).where("used <= 1500")
    g = k.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("fs"), F.count("*").alias("parts"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("fs", lambda x: x["text"]), "\n")).alias("body"), "parts")


@query("r21_see_also", """WITH l AS (SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM orders)
SELECT o_orderkey AS hit, latest AS see_also FROM l WHERE latest <> o_orderkey AND o_orderkey % 20 = 0""")
def r21(spark, d):
    """Hits that have a later version point to the latest one (hits: a stated query set)."""
    o = table(spark, d, "orders")
    latest = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("see_also"))
    return o.where("o_orderkey % 20 = 0").join(latest, "o_custkey").select(F.col("o_orderkey").alias("hit"), "see_also").where("hit <> see_also")


@query("r24_provision_points", f"""SELECT conv_id, turn, 10 * len(list_filter(['than', 'onen', 'tion'], lambda t: contains(lower(coalesce(text, '')), t))) - CASE WHEN left(coalesce(text, ''), 3) = 'The' THEN 12 ELSE 0 END + CASE WHEN contains(coalesce(text, ''), '?') THEN 8 ELSE 0 END AS points FROM conversations""")
def r24(spark, d):
    """Ten points for each term, fewer for framing, more for the intent."""
    t = F.coalesce("text", F.lit(""))
    hits = sum((F.lower(t).contains(k).cast("int") for k in ("than", "onen", "tion")), F.lit(0))
    points = 10 * hits - F.when(F.left(t, F.lit(3)) == "The", 12).otherwise(0) + F.when(t.contains("?"), 8).otherwise(0)
    return table(spark, d, "conversations").select("conv_id", "turn", points.alias("points"))


@query("r26_context_choice", f"""WITH {_BM25}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid), sc AS (SELECT qid, id, round(56.0 * matched / nq + 0.16 * least(100, n_chars / 50.0) + CASE WHEN lang = 'en' THEN 8 ELSE 0 END, 6) AS score FROM r JOIN nq USING (qid) JOIN documents ON doc_id = id WHERE rank <= 100)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 8""")
def r26(spark, d):
    """Coverage, relevance and boosts over the best hundred; eight stay."""
    from ..operators import ranking

    nq = _inputs(spark, d)[1].select("qid", F.size(F.array_distinct(T.tokens(F.col("body")))).alias("nq"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    s = 56.0 * F.col("matched") / F.col("nq") + 0.16 * F.least(F.lit(100.0), F.col("n_chars") / 50.0) + F.when(F.col("lang") == "en", 8).otherwise(0)
    rows = _ranked(spark, d, 100).drop("rank").join(nq, "qid").join(docs, "id").select("qid", "id", F.round(s, 6).alias("score"))
    return ranking.top(rows, "score", 8).select("qid", "id", "score", F.col("rank").cast("long"))


@query("r28_comparables", """WITH s AS (SELECT a.s_suppkey AS suppkey, b.c_custkey AS custkey, round(least(96, greatest(0, 18 + 42 * (b.c_acctbal > 0)::INT + 18 * (abs(a.s_acctbal - b.c_acctbal) < 500)::INT + 22 * least(1, abs(b.c_acctbal) / 10000))), 4) AS score FROM supplier a JOIN customer b ON c_nationkey = s_nationkey)
SELECT suppkey, custkey, score FROM (SELECT *, row_number() OVER (PARTITION BY suppkey ORDER BY score DESC, custkey) AS n FROM s) WHERE n <= 2""")
def r28(spark, d):
    """Weighted matches within one class, held to 96; the two best (a top-k report)."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("b"))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("class"), F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("a"))

    def score(b, near):
        s = 18 + 42 * (b > 0).cast("int") + 18 * near.cast("int") + 22 * F.least(F.lit(1.0), F.abs(b) / 10000)
        return F.when(b.isNull(), 0.0).otherwise(scores.clamp(s, 0.0, 96.0))

    return comparables.nearby_best(rows, c, score, 500, 2)


@query("r29_hub_relevance", """SELECT p_partkey, CASE WHEN p_name = 'small bolt' THEN 2000 WHEN p_name LIKE 'small bolt%' THEN 900 WHEN contains(p_name, 'small bolt') THEN 600 ELSE 0 END + 120 * (contains(p_name, 'small')::INT + contains(p_name, 'bolt')::INT)
 + CASE WHEN contains(p_name, 'small') AND contains(p_name, 'bolt') THEN 800 ELSE 0 END + CASE WHEN p_size > 25 THEN 250 ELSE -75 END AS relevance FROM part""")
def r29(spark, d):
    """A ladder for the title, points for its words, and for the evidence's status."""
    name, needle = F.col("p_name"), "small bolt"
    hits = [name.contains(w) for w in needle.split()]
    ladder = F.when(name == needle, 2000).when(name.startswith(needle), 900).when(name.contains(needle), 600).otherwise(0)
    total = ladder + 120 * sum((h.cast("int") for h in hits), F.lit(0)) + F.when(filters.all_of(hits), 800).otherwise(0) + F.when(F.col("p_size") > 25, 250).otherwise(-75)
    return table(spark, d, "part").select("p_partkey", total.alias("relevance"))


@query("r35_trust_hits", f"""WITH {_BM25}, nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid), k AS (SELECT qid, id // 4 AS record, id, matched / nq AS support FROM r JOIN nq USING (qid) WHERE rank <= 40)
SELECT qid, record, arg_max(id, (round(support, 9), -id)) AS id, round(30 + 55 * max(support), 4) AS score FROM k GROUP BY ALL""")
def r35(spark, d):
    """The best supporting document of each record."""
    nq = _inputs(spark, d)[1].select("qid", F.size(F.array_distinct(T.tokens(F.col("body")))).alias("nq"))
    k = _ranked(spark, d, 40).join(nq, "qid").select("qid", F.floor(F.col("id") / 4).alias("record"), "id", (F.col("matched") / F.col("nq")).alias("support"))
    return k.groupBy("qid", "record").agg(F.max_by("id", F.struct(F.round("support", 9), -F.col("id"))).alias("id"), F.round(30 + 55 * F.max("support"), 4).alias("score"))


@query("x03_fallback_chunks")
def x03(spark, d):
    """Paragraphs packed into blocks of up to 9000 characters; a running state, tested against a plain loop."""
    c = chunks.packed(chunks.paragraphs(F.col("text")), 9000, 0)
    return _docs(spark, d).select("doc_id", F.posexplode(c).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


_LINES = f"SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_D})"


@query("x05_structure", rf"""WITH l AS ({_LINES}), m AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][a-z]{{0,3}}) ', 1), '') AS c, nullif(regexp_extract(line, '^([A-Z][a-z]{{4,}}) ', 1), '') AS a FROM l),
f AS (SELECT *, last_value(c IGNORE NULLS) OVER w AS chapter, max(CASE WHEN c IS NOT NULL THEN line_no END) OVER w AS cat, last_value(a IGNORE NULLS) OVER w AS art, max(CASE WHEN a IS NOT NULL THEN line_no END) OVER w AS aat FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
u AS (SELECT doc_id, line_no, chapter, CASE WHEN aat >= coalesce(cat, -1) THEN art END AS article FROM f)
SELECT doc_id, line_no, doc_id || '-' || CASE WHEN chapter IS NULL AND article IS NULL THEN 'block' || line_no ELSE concat_ws('-', 'c' || chapter, 'a' || article) END AS unit FROM u""")
def x05(spark, d):
    """The unit that each line of a text stands in: markers of two levels filled down, a higher one closes a lower."""
    l = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    u = structure.units(l, "doc_id", "line_no", "line", {"chapter": "^([A-Z][a-z]{0,3}) ", "article": "^([A-Z][a-z]{4,}) "})
    return u.select("doc_id", "line_no", structure.unit_id(F.col("doc_id"), {"c": F.col("chapter"), "a": F.col("article")}, F.col("line_no")).alias("unit"))


@query("x08_structure_counts", rf"""SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]{{0,3}} ')) AS chapters, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]{{4,}} ')) AS articles FROM ({_LINES}) GROUP BY 1""")
def x08(spark, d):
    l = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike("^[A-Z][a-z]{0,3} ")).alias("chapters"), F.count_if(F.col("line").rlike("^[A-Z][a-z]{4,} ")).alias("articles"))


_REFS = "'See Rule No ' || o_custkey || ' of ' || year(o_orderdate) || ' and ' || o_orderkey || '/' || year(o_orderdate) || '.'"


@query("x13_references", f"""WITH t AS (SELECT o_orderkey, {_REFS} AS t, 'Rule No ' || o_custkey || ' of ' || year(o_orderdate) AS a, o_orderkey || '/' || year(o_orderdate) AS b FROM orders)
SELECT o_orderkey, 'named' AS kind, CAST(4 AS BIGINT) AS "start", CAST(4 + length(a) AS BIGINT) AS "end", a AS body FROM t UNION ALL SELECT o_orderkey, 'coded', CAST(4 + length(a) + 5 AS BIGINT), CAST(4 + length(a) + 5 + length(b) AS BIGINT), b FROM t""")
def x13(spark, d):
    """Named, coded and bare references with their places; a bare number inside a named one does not count."""
    y = F.year("o_orderdate").cast("string")
    body = F.concat(F.lit("See Rule No "), F.col("o_custkey").cast("string"), F.lit(" of "), y, F.lit(" and "), F.col("o_orderkey").cast("string"), F.lit("/"), y, F.lit("."))
    patterns = {"named": r"\b[A-Z][a-z]+ No [0-9]+ of [0-9]{4}\b", "coded": r"\b[0-9]+/(?:19|20)[0-9]{2}\b", "bare": r"\bof (?:19|20)[0-9]{2}\b"}
    return structure.references(table(spark, d, "orders").select("o_orderkey", body.alias("t")), "o_orderkey", "t", patterns)


@query("x14_letterhead", r"SELECT page_id, regexp_extract(split_part(left(html, 4000), '<body>', 1), '<title>([^<]*)</title>', 1) AS head FROM pages")
def x14(spark, d):
    """Identity from what stands before the body only."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract(F.element_at(F.split(F.left("html", F.lit(4000)), "<body>"), 1), "<title>([^<]*)</title>", 1).alias("head"))


@query("x18_title_relations", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'amends' ELSE 'repeals' END AS kind, o_custkey || '-' || year(o_orderdate) AS target, 0.97::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 <> 2")
def x18(spark, d):
    """An amending or repealing title gives one edge."""
    k, y = F.col("o_orderkey") % 3, F.year("o_orderdate").cast("string")
    title = F.concat(F.when(k == 0, "Amendment of").when(k == 1, "Repeal of").otherwise("On"), F.lit(" Rule No "), F.col("o_custkey").cast("string"), F.lit(" of "), y)
    kind = F.when(F.col("title").startswith("Amendment"), "amends").when(F.col("title").startswith("Repeal"), "repeals")
    target = F.concat_ws("-", F.regexp_extract("title", "No ([0-9]+) of", 1), F.regexp_extract("title", "of ([0-9]{4})$", 1))
    return table(spark, d, "orders").select("o_orderkey", title.alias("title")).select("o_orderkey", kind.alias("kind"), target.alias("target"), F.lit(0.97).alias("confidence")).where("kind IS NOT NULL")


@query("x26_effective_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 30 END AS effective, CASE WHEN o_orderkey % 2 = 0 THEN 'clause' ELSE 'decree date' END AS reason FROM orders")
def x26(spark, d):
    """The date that a closing clause states, else one derived from the decree's, with the reason."""
    even = F.col("o_orderkey") % 2 == 0
    clause = F.when(even, F.concat(F.lit("This rule takes effect on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("."))).otherwise("This rule takes effect.")
    day = F.try_to_timestamp(F.nullif(F.regexp_extract("clause", "effect on ([0-9]{1,2} [A-Za-z]+ [0-9]{4})", 1), F.lit("")), F.lit("d MMMM yyyy")).cast("date")
    rows = table(spark, d, "orders").withColumn("clause", clause)
    return rows.select("o_orderkey", F.coalesce(day, F.date_add(F.to_date("o_orderdate"), 30)).alias("effective"), F.when(day.isNotNull(), "clause").otherwise("decree date").alias("reason"))


@query("x35_document_kinds", f"SELECT doc_id, CASE WHEN contains(lower(text), 'copyright') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN n_chars < 200 THEN 'note' ELSE 'prose' END AS kind, CASE WHEN n_chars > 10000 THEN 'high' WHEN n_chars > 2000 THEN 'middle' ELSE 'low' END AS level FROM {_D}")
def x35(spark, d):
    kind = F.when(F.lower("text").contains("copyright"), "licence").when(F.col("text").contains("@"), "contact").when(F.col("n_chars") < 200, "note").otherwise("prose")
    return _docs(spark, d).select("doc_id", kind.alias("kind"), F.when(F.col("n_chars") > 10000, "high").when(F.col("n_chars") > 2000, "middle").otherwise("low").alias("level"))


@query("x50_formula_rows", """WITH v AS (SELECT l_orderkey, sum(l_extendedprice * l_tax) AS output, sum(l_extendedprice * l_discount) AS input FROM lineitem GROUP BY 1)
SELECT l_orderkey, unnest(['output', 'payable', 'final']) AS name, round(unnest([output, output - input, greatest(0, output - input)]), 4) AS amount FROM v""")
def x50(spark, d):
    """Output tax, what is payable or refunded, and the final sum."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("o"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("i"))
    due = F.col("o") - F.col("i")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(c, 4).alias("amount")) for n, c in (("output", F.col("o")), ("payable", due), ("final", F.greatest(F.lit(0.0), due)))])
    return v.select("l_orderkey", F.inline(rows))


@query("x51_inherited_marks", """WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'm' || doc_id END AS mark FROM documents), a AS (SELECT id, mark, unnest([0, 1, 2, 3]) AS up FROM n),
p AS (SELECT a.id, up, x.mark FROM a JOIN n x ON x.id = a.id // CAST(pow(4, up) AS BIGINT) WHERE x.mark IS NOT NULL)
SELECT id, arg_min(mark, up) AS mark, min(up) > 0 AS inherited FROM p GROUP BY 1""")
def x51(spark, d):
    """A node's own mark, else the nearest marked ancestor's (paths of a tree of four branches, three levels up)."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    marks = n.where("id % 7 = 0").select(F.col("id").alias("node"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("mark"))
    up = n.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.floor(F.col("id") / F.pow(F.lit(4), k)))).alias("up", "node"))
    return up.join(marks, "node").groupBy("id").agg(F.min_by("mark", "up").alias("mark"), (F.min("up") > 0).alias("inherited"))


@query("p04_case_normaliser", f"SELECT doc_id, len(list_distinct(list_filter(string_split(trim(regexp_replace(replace(replace(lower(text), 'password', 'secret key'), 'license', 'grant of use'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS n FROM {_D}")
def p04(spark, d):
    """Rewrites of several words; distinct tokens."""
    body = T.normalise(F.col("text"), (("password", "secret key"), ("license", "grant of use")))
    return _docs(spark, d).select("doc_id", F.size(F.array_distinct(F.filter(F.split(body, " "), lambda x: x != ""))).cast("long").alias("n"))


@query("p18_list_presentation", "SELECT item_id, len(list_filter(string_split(coalesce(text, ''), '. '), lambda x: trim(x) <> '')) AS items FROM benchmark")
def p18(spark, d):
    items = F.filter(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda x: F.trim(x) != "")
    return table(spark, d, "benchmark").select("item_id", F.size(items).cast("long").alias("items"))


@query("p21_rule_text", "SELECT p_partkey, concat_ws(' ', p_type, p_name, p_brand, CASE WHEN p_size > 25 THEN 'large' END) AS body FROM part")
def p21(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand", F.when(F.col("p_size") > 25, "large")).alias("body"))


@query("p26_comparables", "SELECT d.doc_id, lang AS kind, 70 AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def p26(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("lang").alias("kind"), F.lit(70).alias("score"))


@query("y04_explicit_keys", "SELECT o_orderkey, 'pmk-' || (o_orderkey % 300) || '-' || year(o_orderdate) AS key FROM orders WHERE o_orderkey % 2 = 0")
def y04(spark, d):
    """Canonical keys of the citations in a text, one row for each."""
    y = F.year("o_orderdate").cast("string")
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("under PMK No. "), (F.col("o_orderkey") % 300).cast("string"), F.lit(" Tahun "), y)).otherwise("under no rule")
    return table(spark, d, "orders").select("o_orderkey", F.explode(citations.signals(body)).alias("key"))


@query("y05_node_bonus", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 18 END, 0) + CASE WHEN d.source IS NOT NULL THEN 8 ELSE 0 END - CASE WHEN toxic = 1 THEN 40 ELSE 0 END AS bonus FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def y05(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    bonus = F.when(F.col("quality") == 1, 18).otherwise(0) + F.when(F.col("source").isNotNull(), 8).otherwise(0) - F.when(F.col("toxic") == 1, 40).otherwise(0)
    return rows.select("doc_id", bonus.alias("bonus"))


@query("y31_number_candidates", "SELECT p_partkey, pos, cand FROM (SELECT p_partkey, unnest([0, 1]) AS pos, unnest([regexp_extract(lower(p_brand), '#([0-9]+)', 1) || '-' || p_size, p_size || '/' || regexp_extract(lower(p_brand), '#([0-9]+)', 1)]) AS cand FROM part)")
def y31(spark, d):
    """Candidate numbers of a name in the order in which they are tried."""
    n, size = F.regexp_extract(F.lower("p_brand"), "#([0-9]+)", 1), F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.array(F.concat_ws("-", n, size), F.concat_ws("/", size, n))).alias("pos", "cand"))


@query("y32_linkable", """WITH k AS (SELECT regexp_replace(c_name, '^[^#]+#', '') AS suffix, count(*) AS n FROM customer GROUP BY 1)
SELECT count(*) AS dangling, count(*) FILTER (n = 1) AS linkable, count(*) FILTER (n > 1) AS ambiguous FROM orders LEFT JOIN k ON suffix = lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0')""")
def y32(spark, d):
    """A dry run: how many dangling references a suffix would link."""
    k = matching.unique_targets(table(spark, d, "customer").withColumn("suffix", F.regexp_replace("c_name", "^[^#]+#", "")), ["suffix"], "c_custkey")
    rows = table(spark, d, "orders").select(F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0").alias("suffix")).join(k, "suffix", "left")
    return rows.agg(F.count("*").alias("dangling"), F.count_if(F.col("n") == 1).alias("linkable"), F.count_if(F.col("n") > 1).alias("ambiguous"))


@query("y39_joined_rows_class", """WITH t AS (SELECT conv_id, string_agg(lower(coalesce(text, '')), ' ') AS t FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN contains(t, 'password') THEN 'security' WHEN contains(t, 'than') THEN 'english' ELSE 'other' END AS kind FROM t""")
def y39(spark, d):
    """The class of a record's rows together: a flag for each row, then the flags' maximum; no text is gathered."""
    low = F.lower(F.coalesce("text", F.lit("")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(low.contains("password")).alias("p"), F.bool_or(low.contains("than")).alias("t"))
    return g.select("conv_id", F.when(F.col("p"), "security").when(F.col("t"), "english").otherwise("other").alias("kind"))


@query("y50_evidence_by_path", "SELECT e.event_id, 'props.k' AS path, p.p_partkey FROM events e JOIN part p ON p.p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)")
def y50(spark, d):
    """Facts joined with the evidence that states their value."""
    facts = table(spark, d, "events").select("event_id", F.lit("props.k").alias("path"), F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    return facts.join(table(spark, d, "part").select("p_partkey"), "p_partkey").select("event_id", "path", "p_partkey")


@query("y57_duplicate_guard", "SELECT count(*) AS duplicates, count(*) = 0 AS clean FROM (SELECT sha256(coalesce(text, '')) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def y57(spark, d):
    g = _docs(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("duplicates"), (F.count("*") == 0).alias("clean"))


@query("k05_graph_export", "SELECT l_orderkey AS src, l_partkey AS dst, 1 - l_discount AS confidence FROM lineitem WHERE 1 - l_discount >= 0.95")
def k05(spark, d):
    """Edges over a confidence, written as JSON lines and read back."""
    path = files.scratch(spark, "graph")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (1 - F.col("l_discount")).alias("confidence")).where("confidence >= 0.95")
    files.write_jsonl(e, path)
    return spark.read.schema(e.schema).json(path)


@query("k06_review_csv", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '~7'), doc_id) AS n FROM documents) WHERE n <= 20")
def k06(spark, d):
    """A stratified sample (a sampling operator), written as CSV with a header and read back."""
    from ..operators import graphs

    path = files.scratch(spark, "review")
    rows = graphs.stratified(table(spark, d, "documents"), "lang", "doc_id", 20, 7).select("lang", "doc_id")
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("k08_corpus_import", "SELECT CASE WHEN coalesce(text, '') = '' THEN 'quarantine' WHEN n_chars < 200 THEN 'short' ELSE 'regulations' END AS sink, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def k08(spark, d):
    """Rows routed to their sinks by one write with a partition for each; the sinks are counted from the files."""
    path = files.scratch(spark, "import")
    sink = F.when(F.coalesce("text", F.lit("")) == "", "quarantine").when(F.col("n_chars") < 200, "short").otherwise("regulations")
    table(spark, d, "documents").withColumn("sink", sink).write.partitionBy("sink").parquet(path)
    return spark.read.parquet(path).groupBy("sink").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))

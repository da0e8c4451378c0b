"""Fields, normalisers, chunks and classes read from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from .base import query, spread, table


def _docs(spark, d):
    return spread(table(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


_D = "(SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"


@query("p03_chat_normaliser", f"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(lower(text), ' of the ', ' ofthe '), ' and the ', ' andthe '), '!!', ' loud '), '[^a-z0-9]+', ' ', 'g'))) AS body FROM {_D}")
def p03(spark, d):
    """Rewrites without word boundaries."""
    rewrites = ((" of the ", " ofthe "), (" and the ", " andthe "), ("!!", " loud "))
    return _docs(spark, d).select("doc_id", F.md5(T.normalise(F.col("text"), rewrites)).alias("body"))


@query("p05_answer_normaliser", f"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9%/.-]+', ' ', 'g'))) AS body FROM {_D}")
def p05(spark, d):
    """Keeps per cent signs, slashes, full stops and hyphens."""
    return _docs(spark, d).select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9%/.-]+", " "))).alias("body"))


@query("p08_inner_marks", f"SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS tokens FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9./-]+'), lambda x: rtrim(x, './-')), lambda x: length(x) >= 2) AS ts FROM {_D})")
def p08(spark, d):
    """Tokens that may hold full stops, slashes and hyphens inside."""
    raw = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9./-]+"), F.lit(0))
    ts = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, "[./-]+$", "")), lambda x: F.length(x) >= 2)
    return _docs(spark, d).select("doc_id", ts.alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ")).alias("tokens"))


@query("p09_distinct_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2))) AS n FROM {_D}")
def p09(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.array_distinct(T.tokens(F.col("text"), (), 2))).cast("long").alias("n"))


@query("p12_cleaned", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS body FROM {_D}")
def p12(spark, d):
    """One kind of line end, single spaces, at most one blank line."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return _docs(spark, d).select("doc_id", F.md5(F.trim(t)).alias("body"))


@query("p13_punctuation", f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), '\\n', ' '), ' +([,.;:])', '\\1', 'g'), '[.]{{2,}}', '.', 'g')) AS body FROM {_D}")
def p13(spark, d):
    """Escaped line ends and hard spaces to spaces, none before punctuation, one full stop for several."""
    t = F.replace(F.replace(F.col("text"), F.lit("\xa0"), F.lit(" ")), F.lit("\\n"), F.lit(" "))
    return _docs(spark, d).select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(t, " +([,.;:])", "$1"), "[.]{2,}", ".")).alias("body"))


@query("p14_mentions_removed", "SELECT page_id, md5(regexp_replace(url, '(?i)(example[.](net|com))', 'source', 'g')) AS url, regexp_matches(url, '(?i)example[.](net|com)') AS had FROM pages")
def p14(spark, d):
    """Mentions of third parties' sites replaced."""
    return table(spark, d, "pages").select("page_id", F.md5(F.regexp_replace("url", r"(?i)(example[.](net|com))", "source")).alias("url"), F.col("url").rlike(r"(?i)example[.](net|com)").alias("had"))


@query("p15_private_terms", """SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('than', 'onen', 'the')), ' ')) AS term FROM conversations WHERE role = 'user'""")
def p15(spark, d):
    """A term for the outside without the private words."""
    kept = F.filter(F.split(T.normalise(F.coalesce("text", F.lit(""))), " "), lambda x: ~x.isin("than", "onen", "the"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.array_join(kept, " ")).alias("term"))


@query("p17_clip", f"SELECT doc_id, md5(CASE WHEN length(text) > 360 THEN rtrim(left(text, 359), ' ') || '…' ELSE text END) AS body FROM {_D}")
def p17(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(P.clip(F.col("text"), 360)).alias("body"))


@query("p20_record_text", "SELECT c_custkey, concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, ''), CASE WHEN c_acctbal > 0 THEN 'credit' END, n_name) AS body FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def p20(spark, d):
    """A record's fields as one text, without the empty ones."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    body = F.concat_ws(" ", filled("c_name"), filled("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "credit"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", body.alias("body"))


@query("p22_record_documents", """WITH p AS (SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F')
SELECT CASE WHEN l_partkey IS NULL THEN o_orderkey || ':summary' ELSE o_orderkey || ':' || l_linenumber || ':' || l_partkey END AS id, CASE WHEN l_partkey IS NULL THEN 'unverified' ELSE 'verified' END AS status FROM p""")
def p22_records(spark, d):
    """One document for each verified provision of a record, or one summary."""
    l = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    none, key = F.col("l_partkey").isNull(), F.col("o_orderkey").cast("string")
    part = F.concat_ws(":", key, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    return rows.select(F.when(none, F.concat(key, F.lit(":summary"))).otherwise(part).alias("id"), F.when(none, "unverified").otherwise("verified").alias("status"))


@query("p23_typed_projection", "SELECT s_suppkey AS id, coalesce(nullif(s_name, ''), 'unnamed') AS name, CAST(round(s_acctbal) AS BIGINT) AS balance FROM supplier")
def p23(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(F.nullif(F.col("s_name"), F.lit("")), F.lit("unnamed")).alias("name"), F.round("s_acctbal").cast("long").alias("balance"))


@query("p25_localised", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), url) AS title FROM pages")
def p25(spark, d):
    """The translated title where there is one, else the original."""
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), "url").alias("title"))


@query("p27_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.name'), 'unknown') AS name FROM events")
def p27(spark, d):
    """Every field of a payload with its type and default."""
    p = F.from_json("props", "k long, name string")
    return table(spark, d, "events").select("event_id", F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["name"], F.lit("unknown")).alias("name"))


@query("p29_labels", "SELECT p_partkey, p_brand || ' — ' || CASE WHEN regexp_matches(left(p_name, 1), '[c-l]') THEN 'Clause ' || p_name ELSE 'Article ' || p_size END AS label FROM part")
def p29(spark, d):
    head = F.when(F.left("p_name", F.lit(1)).rlike("[c-l]"), F.concat(F.lit("Clause "), "p_name")).otherwise(F.concat(F.lit("Article "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" — "), head).alias("label"))


@query("p30_path_values", "SELECT event_id, 'props.' || key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def p30_paths(spark, d):
    """Every leaf of a payload as a path and a value."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).select("event_id", F.concat(F.lit("props."), "key").alias("path"), "value")


@query("p31_value_at_path", "SELECT event_id, json_extract_string(props, '$.a.b') AS missing, json_extract_string(props, '$.k') AS k FROM events")
def p31(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.a.b").alias("missing"), F.get_json_object("props", "$.k").alias("k"))


@query("x09_number_forms", """SELECT p_partkey, CASE WHEN f <> '' THEN 'brand-' || regexp_extract(raw, '#([0-9]+)/', 1) || '-' || regexp_extract(raw, '/([0-9]{4})', 1) WHEN regexp_matches(raw, ' no [0-9]+ of [0-9]{4}') THEN 'rule-' || regexp_extract(raw, ' no ([0-9]+)', 1) || '-' || regexp_extract(raw, ' of ([0-9]{4})', 1)
 WHEN regexp_matches(raw, '^[0-9]+-[0-9]{4}$') THEN 'plain-' || raw END AS key FROM (SELECT p_partkey, raw, regexp_extract(raw, '^brand#[0-9]+/[0-9]{4}$') AS f FROM
 (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) || '/' || (1990 + p_size % 30) WHEN 1 THEN 'rule no ' || p_size || ' of ' || (1990 + p_size % 30) WHEN 2 THEN p_size || '-' || (1990 + p_size % 30) ELSE p_name END AS raw FROM part))""")
def x09(spark, d):
    """A number in one of several forms, tried in order, as one key."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    year = (1990 + F.col("p_size") % 30).cast("string")
    raw = F.when(k == 0, F.concat(F.lower("p_brand"), F.lit("/"), year)).when(k == 1, F.concat(F.lit("rule no "), size, F.lit(" of "), year)).when(k == 2, F.concat(size, F.lit("-"), year)).otherwise(F.col("p_name"))
    got = lambda p, g: F.regexp_extract("raw", p, g)
    forms = [("brand", r"^brand#([0-9]+)/([0-9]{4})$"), ("rule", r" no ([0-9]+) of ([0-9]{4})"), ("plain", r"^([0-9]+)-([0-9]{4})$")]
    keys = [F.when(F.col("raw").rlike(p), F.concat_ws("-", F.lit(name), got(p, 1), got(p, 2))) for name, p in forms]
    return table(spark, d, "part").withColumn("raw", raw).select("p_partkey", F.coalesce(*keys).alias("key"))


@query("x10_type_codes", "SELECT DISTINCT o_orderpriority, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'URG' WHEN '2-high' THEN 'HI' ELSE upper(array_to_string(list_transform(string_split(trim(o_orderpriority), ' '), lambda w: left(w, 1)), '')) END AS code FROM orders")
def x10(spark, d):
    return table(spark, d, "orders").select("o_orderpriority").distinct().select("o_orderpriority", P.code_of(F.col("o_orderpriority"), {"1-urgent": "URG", "2-high": "HI"}).alias("code"))


@query("x11_region_keys", "SELECT s_suppkey, 'RULE-' || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE upper(regexp_replace(trim(n_name), '[^A-Za-z0-9]+', '_', 'g')) || '-' END || s_suppkey || '-' || 1999 AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def x11(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    region = F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return table(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", P.region_key(F.lit("rule"), F.col("s_suppkey"), F.lit(1999), region).alias("key"))


@query("x12_alias_keys", "SELECT o_orderkey, upper(o_orderstatus) || '|' || o_custkey || '|' || year(o_orderdate) AS alias FROM orders")
def x12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.alias_key(F.col("o_orderstatus"), F.col("o_custkey"), F.year("o_orderdate")).alias("alias"))


@query("x15_amendment_ordinals", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 ELSE 10 END AS ordinal FROM orders""")
def x15(spark, d):
    k = F.col("o_orderkey") % 5
    title = F.when(k == 0, "Order on fees").when(k == 1, "Amendment to the order").when(k == 2, "Third amendment to the order").when(k == 3, "The Seventh Amendment").otherwise("tenth amendment")
    return table(spark, d, "orders").select("o_orderkey", P.amendment_ordinal(title).alias("ordinal"))


@query("x16_filled_codes", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), 'FROM-' || n_name) AS code FROM customer JOIN nation ON n_nationkey = c_nationkey")
def x16(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    code = F.nullif(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")), F.lit(""))
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", F.coalesce(code, F.concat(F.lit("FROM-"), "n_name")).alias("code"))


@query("x28_last_year_and_panel", "SELECT page_id, list_extract(regexp_extract_all(html, '\\b((?:19|20)[0-9]{2})\\b', 1), -1)::INT AS year, upper(left(regexp_extract(url, '^https?://([a-z]+)[.]', 1), 1)) AS panel FROM pages")
def x28(spark, d):
    return table(spark, d, "pages").select("page_id", P.last_year(F.col("html")).alias("year"), F.upper(F.left(F.regexp_extract("url", "^https?://([a-z]+)[.]", 1), F.lit(1))).alias("panel"))


@query("x29_largest_year", "SELECT page_id, list_max(list_transform(regexp_extract_all(html, '\\b((?:19|20)[0-9]{2})\\b', 1), lambda y: y::INT)) AS year FROM pages")
def x29(spark, d):
    return table(spark, d, "pages").select("page_id", P.largest_year(F.col("html")).alias("year"))


@query("x30_year_of_number", "SELECT o_orderkey, coalesce(list_extract(regexp_extract_all('no ' || o_orderkey || '/' || o_custkey, '\\b((?:19|20)[0-9]{2})\\b', 1), -1)::INT, year(o_orderdate)) AS year FROM orders")
def x30(spark, d):
    number = F.concat(F.lit("no "), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", P.last_year(number, F.year("o_orderdate")).cast("long").alias("year"))


@query("x32_issue_class", f"""WITH n AS (SELECT doc_id, [3 * len(regexp_extract_all(lower(left(text, 400)), 'than')) + len(regexp_extract_all(lower(left(text, 4000)), 'than')), 3 * len(regexp_extract_all(lower(left(text, 400)), 'para')) + len(regexp_extract_all(lower(left(text, 4000)), 'para')),
 3 * len(regexp_extract_all(lower(left(text, 400)), 'sch')) + len(regexp_extract_all(lower(left(text, 4000)), 'sch'))] AS s FROM {_D})
SELECT doc_id, CASE WHEN list_max(s) = 0 THEN 'other' ELSE ['english', 'spanish', 'german'][list_position(s, list_max(s))] END AS issue FROM n""")
def x32(spark, d):
    """Counts in the heading weigh three times those in the first part; the first class wins ties."""
    low = F.lower("text")
    score = [3 * F.regexp_count(F.left(low, F.lit(400)), F.lit(k)) + F.regexp_count(F.left(low, F.lit(4000)), F.lit(k)) for k in ("than", "para", "sch")]
    s = F.array(*score)
    name = F.element_at(F.array(*map(F.lit, ("english", "spanish", "german"))), F.array_position(s, F.array_max(s)).cast("int"))
    return _docs(spark, d).select("doc_id", F.when(F.array_max(s) == 0, "other").otherwise(name).alias("issue"))


@query("x34_section_types", "SELECT conv_id, turn, CASE WHEN contains(lower(coalesce(text, '')), 'what') THEN 'question' WHEN contains(lower(coalesce(text, '')), 'therefore') THEN 'ruling' WHEN role = 'system' THEN 'heading' ELSE 'body' END AS section FROM conversations")
def x34(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(low.contains("what"), "question").when(low.contains("therefore"), "ruling").when(F.col("role") == "system", "heading").otherwise("body").alias("section"))


@query("x36_evidence_labels", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'password') THEN 'secret' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'address' END], lambda x: x IS NOT NULL), ', ') AS labels FROM {_D}")
def x36(spark, d):
    low = F.lower("text")
    labels = F.array_compact(F.array(F.when(low.contains("password"), "secret"), F.when(low.contains("license"), "license"), F.when(F.col("text").contains("@"), "address")))
    return _docs(spark, d).select("doc_id", F.array_join(labels, ", ").alias("labels"))


@query("x37_grouped_amounts", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + (CAST(round(o_totalprice * 100) AS BIGINT) % 100) / 100.0 AS amount FROM orders")
def x37(spark, d):
    """Amounts as printed with full stops between thousands and a decimal comma, read back."""
    cents = (F.round(F.col("o_totalprice") * 100).cast("long") % 100).cast("string")
    raw = F.concat(F.lit("Rp "), F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad(cents, 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", P.grouped_number(F.regexp_replace(raw, "[^0-9.,]", "")).alias("amount"))


@query("x39_amount_near_anchor", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS amount FROM orders")
def x39(spark, d):
    """The first number after an anchor; none without the anchor."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("No 7. "), F.when(k % 3 == 0, "sum ").otherwise("Disputed Amount of "), F.col("o_custkey").cast("string"), F.lit(" and 99"))
    return table(spark, d, "orders").select("o_orderkey", P.amount_near(body, "disputed amount").alias("amount"))


@query("x40_periods", """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS e, CAST(o_orderdate AS DATE) - INTERVAL 20 DAY AS s FROM orders)
SELECT o_orderkey, CAST(s AS DATE) AS "start", e AS "end" FROM p""")
def x40(spark, d):
    """A start without a year takes the end's year, or the one before."""
    end = F.to_date("o_orderdate")
    start = F.date_sub(end, 20)
    p = P.period(F.dayofmonth(start), F.month(start), F.lit(None).cast("int"), F.dayofmonth(end), F.month(end), F.year(end))
    return table(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.start", "p.end")


@query("x44_topics", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|secret|token') THEN 'security' WHEN regexp_matches(lower(text), 'license|copyright') THEN 'licence' WHEN lang = 'de' THEN 'german' ELSE 'general' END AS topic FROM {_D}")
def x44(spark, d):
    low = F.lower("text")
    return _docs(spark, d).select("doc_id", F.when(low.rlike("password|secret|token"), "security").when(low.rlike("license|copyright"), "licence").when(F.col("lang") == "de", "german").otherwise("general").alias("topic"))


@query("x45_status_labels", "SELECT o_orderkey, ['repealed', 'partial', 'in force', 'amended', 'unknown', 'repealed'][o_orderkey % 6 + 1] AS status FROM orders")
def x45(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("Repealed by 7", "Partly repealed", "In force", "Amended, in force", "?", "Not in force"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", P.status_label(raw).alias("status"))


@query("x06_inline_items", """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'one: (a) ' || p_name || ' (b) ' || p_type || ' (c) end' ELSE 'only (a) ' || p_name END AS t FROM part)
SELECT p_partkey, i AS item_no, CASE WHEN p_partkey % 2 = 1 THEN t ELSE ['one:', '(a) ' || regexp_extract(t, '\\(a\\) (.*) \\(b\\)', 1), '(b) ' || regexp_extract(t, '\\(b\\) (.*) \\(c\\)', 1), '(c) end'][i + 1] END AS item
FROM b, unnest(CASE WHEN p_partkey % 2 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS u(i)""")
def x06(spark, d):
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("one: (a) "), "p_name", F.lit(" (b) "), "p_type", F.lit(" (c) end"))).otherwise(F.concat(F.lit("only (a) "), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(P.inline_items(body)).alias("item_no", "item"))


@query("x61_edge_ids", "SELECT l_orderkey, l_linenumber, l_partkey, 'edge:' || left(sha256(l_orderkey || '|' || l_partkey || '|' || l_returnflag || '|'), 24) AS id FROM lineitem")
def x61(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.edge_id(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_returnflag"), F.lit(None)).alias("id"))


@query("d01_temporal_intent", r"""SELECT conv_id, turn, coalesce(try_cast(nullif(regexp_extract(t, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1), '') AS DATE), CASE WHEN regexp_extract(t, '\b((?:19|20)[0-9]{2})\b', 1) <> '' THEN make_date(regexp_extract(t, '\b((?:19|20)[0-9]{2})\b', 1)::INT, 12, 31) END,
 CASE WHEN regexp_matches(t, '\b(now|is)\b') THEN DATE '2024-06-30' END) AS as_of FROM (SELECT conv_id, turn, lower(coalesce(text, '')) || CASE conv_id % 4 WHEN 0 THEN ' on 2021-03-04' WHEN 1 THEN ' in 1999' ELSE '' END AS t FROM conversations)""")
def d01(spark, d):
    """An explicit date, else the last day of a named year, else today for words of the present."""
    k = F.col("conv_id") % 4
    t = F.concat(F.lower(F.coalesce("text", F.lit(""))), F.when(k == 0, " on 2021-03-04").when(k == 1, " in 1999").otherwise(""))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract("t", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    year = F.nullif(F.regexp_extract("t", r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")
    now = F.when(F.col("t").rlike(r"\b(now|is)\b"), F.lit("2024-06-30").cast("date"))
    return table(spark, d, "conversations").withColumn("t", t).select("conv_id", "turn", F.coalesce(day, F.make_date(year, F.lit(12), F.lit(31)), now).alias("as_of"))


@query("d05_document_years", "SELECT page_id, coalesce(nullif(regexp_extract(url, '/((?:19|20)[0-9]{2})\\b', 1), '')::INT, list_max(list_transform(regexp_extract_all(html, '\\b((?:19|20)[0-9]{2})\\b', 1), lambda y: y::INT)), 0) AS year FROM pages")
def d05(spark, d):
    """The explicit year, else one in the text, else 0."""
    explicit = F.nullif(F.regexp_extract("url", r"/((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")
    return table(spark, d, "pages").select("page_id", F.coalesce(explicit, P.largest_year(F.col("html")), F.lit(0)).alias("year"))


@query("d06_retention", """SELECT event_id, CAST(CAST(ts AS DATE) + INTERVAL (CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 3650 ELSE 90 END) DAY AS DATE) AS due,
 CASE WHEN value > 180 THEN 'hold' WHEN CAST(ts AS DATE) + INTERVAL (CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 3650 ELSE 90 END) DAY <= DATE '2024-02-20' THEN 'delete' ELSE 'keep' END AS disposition FROM events""")
def d06(spark, d):
    """Kept for its category's days; a hold stops deletion."""
    days = F.when(F.col("event_type") == "error", 30).when(F.col("event_type") == "purchase", 3650).otherwise(90)
    due = F.date_add(F.to_date("ts"), days)
    what = F.when(F.col("value") > 180, "hold").when(due <= F.lit("2024-02-20").cast("date"), "delete").otherwise("keep")
    return table(spark, d, "events").select("event_id", due.alias("due"), what.alias("disposition"))


@query("d08_iso_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def d08(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", P.iso_day(raw).alias("day"))

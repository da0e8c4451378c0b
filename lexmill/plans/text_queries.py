"""Normalisation, extraction and classification over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import query, spread, table

_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TOKENS = f"list_filter(string_split({_NORM}, ' '), lambda x: length(x) > 1 AND x NOT IN {_STOP})"


def _docs(spark, d):
    return spread(table(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


@query("p01_normalise", f"SELECT doc_id, md5({_NORM}) AS norm_md5 FROM documents")
def p01(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalise(F.col("text"))).alias("norm_md5"))


@query("p02_tokens", f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct FROM t")
def p02(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return t.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query("p07_terms", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}'), lambda x: NOT regexp_matches(x, '^[0-9]+$'))) AS n_terms FROM documents")
def p07(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"))


@query("p10_term_frequencies", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL")
def p10(spark, d):
    t = _docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("p16_compact", r"""SELECT doc_id, CASE WHEN length(s) > 120 THEN regexp_replace(left(s, 120), ' [^ ]*$', '') || '...' ELSE s END AS short
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')) AS s FROM documents)""")
def p16(spark, d):
    return _docs(spark, d).select("doc_id", T.compact(T.squeeze(F.col("text")), 120).alias("short"))


@query("p22_line_chunks", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, length(ls[i]) AS n_chars, md5(ls[i]) AS line_md5 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)")
def p22(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long"), F.length("line").cast("long").alias("n_chars"), F.md5("line").alias("line_md5"))


@query("p24_json_projection", """SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || ',"n":' || length(coalesce(text, '')) || '}' AS payload FROM documents""")
def p24(spark, d):
    return _docs(spark, d).select("doc_id", F.to_json(F.struct("doc_id", "lang", F.length("text").alias("n"))).alias("payload"))


@query("p28_detail_url", "SELECT s_suppkey, 'https://example.org/d/' || replace(s_name, '#', '%23') || '%20x' AS url FROM supplier")
def p28(spark, d):
    key = F.replace(F.url_encode(F.concat("s_name", F.lit(" x"))), F.lit("+"), F.lit("%20"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://example.org/d/"), key).alias("url"))


@query("x04_word_count", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n_words FROM documents")
def x04(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("x17_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*'),
  lambda x: trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, len(ss) AS n_sentences, CAST(coalesce(list_max(list_transform(ss, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s""")
def x17(spark, d):
    s = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("ss"))
    return s.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("ss", F.length)), F.lit(0)).cast("long").alias("longest"))


_LABELS = {"symbols": (r"\*\*\*", r"\$\$\$", "###"), "shouting": ("!!",), "tables": (r" \| ",), "secrets": ("token", "password", "secret")}


@query("x31_keyword_label", r"""WITH n AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(t, '\*\*\*')) + len(regexp_extract_all(t, '\$\$\$')) + len(regexp_extract_all(t, '###')) AS a,
 len(regexp_extract_all(t, '!!')) AS b, len(regexp_extract_all(t, ' \| ')) AS c,
 len(regexp_extract_all(t, 'token')) + len(regexp_extract_all(t, 'password')) + len(regexp_extract_all(t, 'secret')) AS e FROM n)
SELECT doc_id, CASE greatest(a, b, c, e) WHEN 0 THEN 'plain' WHEN a THEN 'symbols' WHEN b THEN 'shouting' WHEN c THEN 'tables' ELSE 'secrets' END AS label FROM c""")
def x31(spark, d):
    return _docs(spark, d).select("doc_id", T.keyword_label(F.col("text"), _LABELS, "plain").alias("label"))


@query("x38_numbers", "SELECT event_id, CAST(replace(printf('%.2f', value), ',', '') AS DOUBLE) AS shown, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value IS NOT NULL")
def x38(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select("event_id", T.number(F.format_number("value", 2)).alias("shown"), F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("x43_numeric_facts", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)?%?'),
 lambda x: replace(x, ',', '.')))), '|') AS facts FROM documents""")
def x43(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.numeric_facts(F.col("text")), "|").alias("facts"))


@query("x60_content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g'))) AS content_sha256 FROM documents")
def x60(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.squeeze(F.lower("text")), 256).alias("content_sha256"))


@query("y19_html_text", r"""WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g')) AS title,
 md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5 FROM s""")
def y19(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.html_title(F.col("html")).alias("title"), F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


@query("y20_links", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1),
 lambda u: regexp_replace(u, '#.*$', '')), lambda u: u <> ''))), ' ') AS links FROM pages""")
def y20(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.links(F.col("html")), " ").alias("links"))


@query("f10_host_buckets", """SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, CASE WHEN starts_with(url, 'https:') THEN 'https' ELSE 'other' END AS scheme, count(*) AS n FROM pages GROUP BY ALL""")
def f10(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(T.host(F.col("url")).alias("host"), F.when(F.col("url").startswith("https:"), "https").otherwise("other").alias("scheme")).agg(F.count("*").alias("n"))


@query("r30_snippets", r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents),
p AS (SELECT doc_id, t, greatest(1, coalesce(list_min(list_filter([instr(l, 'token'), instr(l, 'the'), instr(l, 'der')], lambda x: x > 0)), 1) - 40) AS s FROM t)
SELECT doc_id, md5(substring(t, s, 160)) AS snippet_md5 FROM p""")
def r30(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.snippet(F.col("text"), ("token", "the", "der"))).alias("snippet_md5"))


@query("u11_identical_texts", r"""WITH n AS (SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g'))) AS h FROM documents)
SELECT h AS text_md5, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM n GROUP BY h HAVING count(*) > 1""")
def u11(spark, d):
    n = _docs(spark, d).select("doc_id", F.md5(T.squeeze(F.lower("text"))).alias("text_md5"))
    return n.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("q13_turn_numbers", r"""SELECT conv_id, role, count(*) AS turns, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS BIGINT) AS numbers,
 CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY ALL""")
def q13(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(
        F.count("*").alias("turns"), F.sum(F.regexp_count(t, F.lit("[0-9]+"))).alias("numbers"), F.sum(F.length(t)).alias("chars")
    )

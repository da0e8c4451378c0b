"""Page fields, an import of several tables, and a catalogue absorbed by identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, pages
from ..operators import imports
from ..sources.files import scratch
from .base import query, spread, table

_PATHS = {"name": ("$.name", "$.article.headline"), "number": ("$.id", "$.article.number"), "day": ("$.dates[0]", "$.article.date")}


def _with_blocks(spark, d):
    """The pages with script blocks before the end of the head: JSON of two shapes, broken and empty blocks."""
    k = F.col("page_id")
    s = k.cast("string")
    one = F.concat(F.lit('{"id": '), s, F.lit(', "name": "N'), s, F.lit('", "dates": ["2020-01-02", 5]}'))
    two = F.concat(F.lit('{"article": {"headline": "H'), s, F.lit('", "number": "x'), s, F.lit('"}}'))
    body = F.when(k % 4 == 0, one).when(k % 4 == 1, two).when(k % 4 == 2, F.concat(F.lit('{"id": '), s)).otherwise(F.lit("  "))
    block = F.concat(F.lit('<script async type="application/ld+json">'), body, F.lit('</script><script type="application/json">[1, {"name": "late"}]</script></head>'))
    return spread(table(spark, d, "pages")).select("page_id", F.concat(F.split_part("html", F.lit("</head>"), F.lit(1)), block, F.split_part("html", F.lit("</head>"), F.lit(2))).alias("html"))


@query("s19_page_fields", r"""WITH p AS (SELECT page_id AS k, html FROM pages)
SELECT k AS page_id, regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*["'']([^"''>]*)', 1) AS lang, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')), '') AS heading,
 CASE k % 4 WHEN 0 THEN 'N' || k WHEN 1 THEN 'H' || k END AS name, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'x' || k END AS number, CASE k % 4 WHEN 0 THEN '2020-01-02' END AS day,
 CASE k % 4 WHEN 2 THEN 'malformed' WHEN 3 THEN 'empty' END AS aside FROM p""")
def s19(spark, d):
    """Fields of the markup and of embedded JSON of two shapes; blocks that cannot be read are named aside."""
    rows = _with_blocks(spark, d)
    found, aside = pages.fields(rows, "page_id", "html", _PATHS)
    markup = rows.select("page_id", pages.attribute(F.col("html"), "html", "lang").alias("lang"), pages.inner(F.col("html"), "h1").alias("heading"))
    why = aside.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), " ").alias("aside"))
    return markup.join(found, "page_id").join(why, "page_id", "left").select("page_id", "lang", "heading", "name", "number", "day", "aside")


@query("k08_committed_import", """WITH d AS (SELECT *, coalesce(text, '') = '' OR lang IS NULL AS bad FROM documents), v AS (SELECT * FROM d WHERE NOT bad),
l AS (SELECT v.doc_id, w.doc_id AS other FROM v JOIN v w ON v.source = w.source AND w.doc_id = v.doc_id + 1)
SELECT name, CAST("rows" AS BIGINT) AS "rows", CAST(1 AS BIGINT) AS version FROM (SELECT 'records' AS name, count(*) AS "rows" FROM v UNION ALL SELECT 'chunks', coalesce(sum(len(string_split(text, chr(10)))), 0) FROM v
 UNION ALL SELECT 'links', count(*) FROM l UNION ALL SELECT 'quarantine', count(*) FROM d WHERE bad)""")
def k08(spark, d):
    """Documents split into records, chunks, links and quarantine, committed as one set; the second import of the
    same rows, in another order, is no new version."""
    docs = spread(table(spark, d, "documents"))
    bad = (F.coalesce("text", F.lit("")) == "") | F.col("lang").isNull()
    good = docs.where(~bad)
    a, b = good.select("doc_id", "source").alias("a"), good.select("doc_id", "source").alias("b")
    split = {
        "records": good.select("doc_id", "lang", "source", "n_chars"), "chunks": good.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "chunk")),
        "links": a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("b.doc_id") == F.col("a.doc_id") + 1)).select(F.col("a.doc_id").alias("src"), F.col("b.doc_id").alias("dst")),
        "quarantine": docs.where(bad).select("doc_id", F.when(F.col("lang").isNull(), "no language").otherwise("no text").alias("reason")),
    }
    path = scratch(spark, "import")
    imports.write_all(split, path)
    imports.write_all({n: t.repartition(t.columns[0]) for n, t in split.items()}, path)
    return imports.commits(spark, path).select("name", "rows", "version")


@query("y26_catalogue_absorb", """WITH b AS (SELECT 'pmk-' || c_custkey || '-2010' AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS title, CAST(c_nationkey AS VARCHAR) AS kind FROM customer WHERE c_custkey % 2 = 0),
i AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE 'pmk-' || o_custkey || '-2010' END AS key, 'T' || o_orderkey AS title FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS turn FROM i WHERE key IS NOT NULL),
f AS (SELECT * FROM t WHERE turn = 1)
SELECT coalesce(b.key, f.key) AS key, coalesce(b.title, f.title) AS title, b.kind, CASE WHEN f.key IS NULL THEN 'not asked' WHEN b.key IS NULL THEN 'inserted' WHEN b.title IS NULL THEN 'filled' ELSE 'unchanged' END AS outcome FROM b FULL JOIN f ON f.key = b.key""")
def y26(spark, d):
    """Catalogue rows whose identity is read from their citation: filled, inserted or skipped."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.concat(F.lit("pmk-"), F.col("c_custkey").cast("string"), F.lit("-2010"))
    base = c.where("c_custkey % 2 = 0").select(key.alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title"), F.col("c_nationkey").cast("string").alias("kind"))
    cited = F.when(F.col("o_orderkey") % 10 == 9, "no number here").otherwise(F.concat(F.lit("PMK Nomor 0"), F.col("o_custkey").cast("string"), F.lit(" Tahun 2010")))
    rows = o.select(F.col("o_orderkey").alias("place"), cited.alias("citation"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("kind"))
    taken, log = imports.absorb(base, rows, F.get(citations.signals(F.col("citation")), 0))
    kept = log.where("outcome NOT LIKE 'skipped%'").select("key", "outcome")
    return taken.join(kept, "key", "left").select("key", "title", "kind", F.coalesce("outcome", F.lit("not asked")).alias("outcome"))

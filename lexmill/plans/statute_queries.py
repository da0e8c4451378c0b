"""Statutes written from the tables' rows: their units, and the relations that their texts state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations, statutes
from .base import query, table

_EFFECT = "Peraturan ini mulai berlaku pada tanggal diundangkan."


@query("x05_statute_units", f"""WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderpriority AS p FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, l_linestatus AS a, l_returnflag AS b,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) || chr(10), l_linestatus, l_returnflag) AS i FROM lineitem JOIN o ON k = l_orderkey),
u AS (SELECT k, 0 AS pos, 'kepala' AS section, 'kepala' AS path, 'kepala' AS id, 'UNDANG-UNDANG NOMOR ' || k || ' TAHUN ' || y AS text FROM o
 UNION ALL SELECT k, 1, 'menimbang', 'menimbang', 'menimbang', 'bahwa ' || p FROM o UNION ALL SELECT k, 2, 'mengingat', 'angka 1', 'mengingat-angka-1', 'Pasal 5 UUD' FROM o
 UNION ALL SELECT k, 10 * i, 'batang_tubuh', 'BAB I KETENTUAN > Pasal ' || n || ' > ayat (1)', 'pasal-' || n || '-ayat-1', 'jumlah ' || q || ' Pasal C' FROM l
 UNION ALL SELECT k, 10 * i + 1, 'batang_tubuh', 'BAB I KETENTUAN > Pasal ' || n || ' > ayat (2)', 'pasal-' || n || '-ayat-2', 'cara:' FROM l
 UNION ALL SELECT k, 10 * i + 2, 'batang_tubuh', 'BAB I KETENTUAN > Pasal ' || n || ' > ayat (2) > huruf a', 'pasal-' || n || '-ayat-2-huruf-a', a FROM l
 UNION ALL SELECT k, 10 * i + 3, 'batang_tubuh', 'BAB I KETENTUAN > Pasal ' || n || ' > ayat (2) > huruf b', 'pasal-' || n || '-ayat-2-huruf-b', b FROM l
 UNION ALL SELECT k, 1000, 'penutup', 'BAB I KETENTUAN > Pasal 99', 'penutup-pasal-99', '{_EFFECT}' FROM o
 UNION ALL SELECT k, 1001, 'penjelasan', 'BAB I KETENTUAN > Pasal 1', 'penjelasan-pasal-1', 'Cukup jelas.' FROM o)
SELECT k AS o_orderkey, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INT) AS seq, section, path, k || '#' || id AS unit_id, text FROM u""")
def x05(spark, d):
    """Units of six levels with ids and paths, from the text of a statute for each order."""
    s = lambda c: F.col(c).cast("string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").cast("string").alias("y"), F.col("o_orderpriority").alias("p"))
    article = F.concat_ws(
        "\n", F.concat(F.lit("Pasal "), s("l_linenumber")), F.concat(F.lit("(1) jumlah  "), F.col("l_quantity").cast("int").cast("string")), F.lit("Pasal C"),
        F.lit("(2) cara:"), F.concat(F.lit("  a. "), F.col("l_linestatus")), F.concat(F.lit("b. "), F.col("l_returnflag")),
    )
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", article.alias("t")))).alias("articles"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("UNDANG-UNDANG NOMOR "), s("k"), F.lit(" TAHUN "), F.col("y")), F.concat(F.lit("Menimbang : bahwa "), F.col("p")), F.lit("Mengingat:\n1. Pasal 5 UUD\n\nMEMUTUSKAN:\nBAB I KETENTUAN"),
        F.array_join("articles.t", "\n"), F.lit(f"Pasal 99\n{_EFFECT}\nPENJELASAN\nPasal 1\nCukup jelas."),
    )
    u = statutes.units(o.join(l, "k", "left").select("k", text.alias("text")), "k", "text")
    return u.select(F.col("key").alias("o_orderkey"), "seq", "section", "path", statutes.unit_id().alias("unit_id"), "text")


def _corpus(spark, d):
    """statutes (id, short, title) and units (id, unit_id, seq, section, text), one statute for each order."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    law = lambda n: F.concat(F.lit("Undang-Undang Nomor "), n.cast("string"), F.lit(" Tahun "), y)
    own = F.concat(F.lit("uu-"), k.cast("string"), F.lit("-"), y)
    o = table(spark, d, "orders").where("o_orderkey > 2")
    title = F.when(k % 6 == 0, F.concat(F.lit("PERUBAHAN ATAS "), F.upper(law(k - 1)))).otherwise("TENTANG PAJAK")
    special = {
        1: ("penutup", F.concat(F.lit("Pada saat Undang-Undang ini mulai berlaku, "), law(k - 1), F.lit(" dicabut dan dinyatakan tidak berlaku."))),
        2: ("batang_tubuh", F.concat(law(k - 1), F.lit(" tetap berlaku."))),
        3: ("penjelasan", F.concat(law(k - 1), F.lit(" sebagaimana telah  diubah dengan "), law(k - 2))),
        4: ("batang_tubuh", F.concat(F.lit("Beberapa ketentuan dalam "), law(k - 1), F.lit(" sebagaimana telah diubah dengan "), law(k - 2), F.lit(" diubah sebagai berikut: Pasal 1"))),
        5: ("menimbang", F.concat(F.lit("bahwa untuk melaksanakan ketentuan Pasal 4 ayat (2) "), law(k - 1), F.lit(" perlu diatur"))),
    }
    section, text = F.lit("kepala"), F.lit("Isi")
    for m, (s, t) in special.items():
        section, text = F.when(k % 6 == m, s).otherwise(section), F.when(k % 6 == m, t).otherwise(text)
    bases = F.concat(F.lit("1. PER-"), F.col("o_custkey").cast("string"), F.lit("/PJ/"), y, F.lit("; 2. Keputusan Menteri Keuangan Nomor "), (k % 900).cast("string"), F.lit("/KMK.014/"), y)
    rows = [("mengingat", bases), ("kepala", F.lit("Isi")), ("kepala", F.lit("Isi"))]
    units = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).alias("section"), t.alias("text")) for i, (s, t) in enumerate(rows)], F.struct(F.lit(3).alias("seq"), section.alias("section"), text.alias("text")))
    each = o.select(own.alias("id"), F.inline(units)).withColumn("unit_id", F.concat_ws("#", "id", "seq"))
    return o.select(own.alias("id"), own.alias("short"), title.alias("title")), each


@query("x24_relations", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, 'uu-' || o_orderkey || '-' || year(o_orderdate) AS id FROM orders WHERE o_orderkey > 2),
p AS (SELECT *, 'uu-' || (k - 1) || '-' || y AS one, 'uu-' || (k - 2) || '-' || y AS two FROM o),
e AS (SELECT id AS source, 'DASAR_HUKUM' AS type, 'per-' || c || '-pj-' || y AS target_key, 0.99 AS confidence, 'preamble' AS rule, id || '#0' AS unit_id, NULL AS scope FROM p
 UNION ALL SELECT id, 'DASAR_HUKUM', 'kmk-' || (k % 900) || '-kmk.014-' || y, 0.99, 'preamble', id || '#0', NULL FROM p
 UNION ALL SELECT id, 'MENGUBAH', one, 0.97, 'title', NULL, NULL FROM p WHERE k % 6 = 0
 UNION ALL SELECT id, 'MENCABUT', one, 0.95, 'closing', id || '#3', NULL FROM p WHERE k % 6 = 1
 UNION ALL SELECT two, 'MENGUBAH', one, 0.80, 'as amended by', id || '#3', NULL FROM p WHERE k % 6 IN (3, 4)
 UNION ALL SELECT id, 'MENGUBAH', one, 0.93, 'omnibus', id || '#3', NULL FROM p WHERE k % 6 = 4
 UNION ALL SELECT id, 'MENGUBAH', two, 0.85, 'omnibus', id || '#3', NULL FROM p WHERE k % 6 = 4
 UNION ALL SELECT id, 'MELAKSANAKAN', one, 0.85, 'preamble', id || '#3', 'Pasal 4 ayat (2)' FROM p WHERE k % 6 = 5)
SELECT source, type, target_key, o.id AS target_id, CAST(confidence AS DOUBLE) AS confidence, rule, unit_id, scope FROM e LEFT JOIN o ON o.id = target_key""")
def x24(spark, d):
    """All rules over the corpus, resolved."""
    return relations.extract(*_corpus(spark, d)).select("source", "type", "target_key", "target_id", "confidence", "rule", "unit_id", "scope")

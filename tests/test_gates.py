import datetime
import re

from pyspark.sql import functions as F

from lexmill.functions import gates


def of(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_sentences_spare_abbreviations(spark):
    texts = [
        "See no. 5 of Art. 7. Then (more). It costs 3.50 now! Really? Yes.", "Dr. Who met J. Smith vs. Jones. End", "1. First item. 2. Second", "PMK.03 stays. (A) too", "lower. case stays", None, "",
        "Épée. Ünder etc. Always", "Is no. Good. \"Quoted.\" Next",
    ]
    spared = {"no", "art", "dr", "mr", "mrs", "st", "vs", "etc"}

    def by_loop(t):
        t, out, start = " ".join((t or "").split()), [], 0
        for m in re.finditer(r"[.!?] ", t):
            before = re.search(r"(\w+)\.$", t[: m.start() + 1])
            word = before[1] if before else ""
            kept = word in spared or word in {s.capitalize() for s in spared} or len(word) == 1
            after = t[m.end() : m.end() + 1]
            if not kept and (after.isupper() or after in "(\"'"):
                out.append(t[start : m.end() - 1])
                start = m.end()
        return [x for x in (*out, t[start:]) if x]

    assert of(spark, texts, gates.sentences) == [by_loop(t) for t in texts]


def test_periods(spark):
    d = datetime.date
    texts = ["berlaku 28 Desember sampai dengan 3 Januari 2021", "1 Mei 2020  s.d. 7 mei 2020", "31 Februari 2020 sampai dengan 2 Maret 2020", "3 Mei sampai dengan 31 Juni 2020", "1 Foo sampai dengan 2 Mei 2020", None, "29 Februari - 1 Maret 2020; 1 Mei - 2 Mei 2021"]
    got = [x and (x["start"], x["end"]) for x in of(spark, texts, gates.period_in)]
    assert got == [(d(2020, 12, 28), d(2021, 1, 3)), (d(2020, 5, 1), d(2020, 5, 7)), None, None, None, None, (d(2020, 2, 29), d(2020, 3, 1))]


def test_numbers_in_both_conventions(spark):
    cases = {"13.665,00": 13665.0, "15,615.00": 15615.0, "1.234": 1234.0, "1,234": 1234.0, "1,5": 1.5, "0.25": 0.25, "1.234.567": 1234567.0, "7-": 7.0, "1.234.56": 123456.0, "": None, "x": None, "12,": 12.0}
    assert of(spark, list(cases), gates.number) == list(cases.values())


def test_rate_rows(spark):
    text = "1. 13.665,00 Dolar  Amerika Serikat (usd) per 1;\n2. 1,5 Yen (JPY) per 100 3. 9,00 Again (USD) 4. , None (ABC) 12. 7 Euro (EUR)"
    (rows, none) = of(spark, [text, None], gates.rate_rows)
    assert [tuple(r) for r in rows] == [(1, "USD", "Dolar Amerika Serikat", 13665.0, 1.0), (2, "JPY", "Yen", 1.5, 100.0), (12, "EUR", "Euro", 7.0, 1.0)] and none == []


def test_domain_gate(spark):
    gate = lambda t: gates.domain_gate(t, {"tax": "tax", "vat": "vat"}, {"rate": "rate"}, {"cook": "recipe"}, ("tax",))
    got = [(x["in_scope"], x["score"], x["signals"], x["exclusions"]) for x in of(spark, ["Tax rate", "rate", "vat recipe", "tax vat recipe", "tax recipe", None, "va"], gate)]
    assert got == [(True, 43, ["tax", "rate"], []), (False, 8, ["rate"], []), (False, 0, ["vat"], ["cook"]), (True, 35, ["tax", "vat"], ["cook"]), (False, 0, ["tax"], ["cook"]), (False, 0, [], []), (False, 0, [], [])]

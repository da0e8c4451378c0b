import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import relations, statutes

LEVELS = ["chapter", "part", "article", "paragraph", "letter", "number"]


def units_by_loop(text):
    """The same reading, line after line: (section, labels, path, text)."""
    open_, section, pieces, out, title = dict.fromkeys(LEVELS), "kepala", [], [], ""

    def close(level):
        for x in LEVELS[LEVELS.index(level):]:
            open_[x] = None

    def end():
        body = re.sub("^[: ]+", "", " ".join(p for p in pieces if p)).strip()
        pieces.clear()
        if body:
            a = open_["article"]
            named = a and ("Pasal " if re.fullmatch(r"\d+[A-Za-z]?|[IVXivx]+", a) else "Diktum ") + a
            path = [open_["chapter"] and f"BAB {title}", open_["part"], named, open_["paragraph"] and f"ayat ({open_['paragraph']})",
                    open_["letter"] and f"huruf {open_['letter']}", open_["number"] and f"angka {open_['number']}"]
            out.append([section, *open_.values(), " > ".join(filter(None, path)) or section, body])

    for line in (" ".join(x.split()) for x in (text or "").split("\n")):
        low, m = line.lower(), None
        if not line:
            continue
        head = next((s for s, p in (("penjelasan", r"penjelasan\b"), ("menimbang", "menimbang"), ("mengingat", "mengingat"), ("batang_tubuh", "memutuskan|menetapkan")) if re.match(p, low)), None)
        word = re.match(r"([A-Za-z ]+?)\s*(?::\s*(.*))?$", line)
        if head:
            end()
            section = head
            if head == "penjelasan":
                close("article")
            elif head == "batang_tubuh":
                close("paragraph")
            else:
                pieces.append(re.sub(r"(?i)^\w+\s*:?", "", line).strip())
        elif word and word[1].lower() in statutes.ORDINALS and section in ("batang_tubuh", "kepala"):
            end()
            close("article")
            open_["article"], section = word[1].upper(), "batang_tubuh"
            pieces.append(word[2] or "")
        elif m := re.match(r"(?i)bab\s+([ivxlc]+)\b(.*)", line):
            end()
            close("chapter")
            open_["chapter"], section, title = m[1].upper(), "batang_tubuh", (m[1].upper() + " " + m[2].strip()).strip()
        elif re.match(r"(?i)(bagian\s+\w+|paragraf\s+\d+)\b", line):
            end()
            close("part")
            open_["part"] = line
        elif (m := re.match(r"(?i)pasal\s+(\d+[a-z]?|X?I{1,3}|IV|VI{0,3}|IX|XI?|XII)\b\s*(.*)", line)) and not (m[2] and section == "mengingat"):
            end()
            close("article")
            open_["article"] = m[1]
            if section in ("kepala", "menimbang", "mengingat"):
                section = "batang_tubuh"
            pieces.append(m[2])
        else:
            body = section in ("batang_tubuh", "penjelasan")
            for level, p in (("paragraph", r"\((\d+[a-z]?)\)\s*(.*)"), ("letter", r"([a-z])\.\s+(.*)"), ("number", r"(\d{1,2})\.\s+(.*)")):
                m = re.match(p, line)
                if m and (body and (level != "number" or open_["article"]) or level == "number" and section == "mengingat"):
                    end()
                    close(level)
                    open_[level] = m[1]
                    pieces.append(m[2])
                    break
            else:
                pieces.append(line)
    end()
    last = next((u for u in reversed(out) if u[0] == "batang_tubuh" and re.search(statutes.EFFECT, u[-1])), None)
    for u in out:
        if last and u[0] == "batang_tubuh" and u[3] == last[3]:
            u[0] = "penutup"
    return [(i, *u) for i, u in enumerate(out, 1)]


LINES = [
    "BAB I KETENTUAN UMUM", "bab iv", "Bagian Kesatu Umum", "Paragraf 2", "Pasal 1", "Pasal 2A", "PASAL II", "Pasal 7 tentang pajak", "Pasal 5.", "Pasal C", "(1) satu", "(2a) dua",
    "a. huruf a", "b. huruf b", "1. angka", "12. angka lagi", "123. bukan", "Menimbang: bahwa", "MENGINGAT :", "Mengingat", "MEMUTUSKAN:", "Menetapkan : PERATURAN", "PENJELASAN", "PENJELASANNYA", "KESATU",
    "KEDUA :", "KEEMPAT BELAS: isi", "ketiga  belas :", "KESATU tanpa titik dua", "teks biasa", "  :  ", "", "   ", "Undang-Undang ini mulai berlaku pada tanggal diundangkan.", "mulai  berlaku 5 Mei 2020", "(x) bukan", "B. bukan",
]


def test_units_equal_a_plain_loop(spark):
    rng = random.Random(6)
    docs = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.choice([1, 5, 20, 60])))) for i in range(250)] + [(900, None), (901, " \n "), (902, "one line")]
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc long, body string, seq string")
    got = {}
    for r in statutes.units(rows, "doc", "body").orderBy("key", "seq").collect():
        got.setdefault(r["key"], []).append((r["seq"], r["section"], *[r[n] for n in LEVELS], r["path"], r["text"]))
    for i, t in docs:
        assert got.get(i, []) == units_by_loop(t), t


def test_unit_ids(spark):
    text = "Judul\nMengingat:\n1. Pasal 5\nBAB I A\nPasal 1\n(1) x\na. y\n1. z\nPasal 2 mulai berlaku pada tanggal ditetapkan\nPENJELASAN\nPasal 1\nCukup jelas"
    rows = statutes.units(spark.createDataFrame([("uu-1-2000", text)], "k string, t string"), "k", "t").select("seq", statutes.unit_id().alias("id")).orderBy("seq").collect()
    assert [r["id"].removeprefix("uu-1-2000#") for r in rows] == [
        "kepala", "mengingat-angka-1", "pasal-1-ayat-1", "pasal-1-ayat-1-huruf-a", "pasal-1-ayat-1-huruf-a-angka-1", "penutup-pasal-2", "penjelasan-pasal-1",
    ]


UU, PMK, PER = "Undang-Undang Nomor 6 Tahun 1983", "Peraturan Menteri Keuangan Nomor 252/PMK.03/2008", "PER-31/PJ/2009"


@pytest.mark.parametrize("text, want", [
    (f"{UU} dan {PMK}, juga {PER} serta 11/PMK.05/2020.", ["UU-6--1983", "PMK-252-PMK.03-2008", "PER-31-PJ-2009", "PMK-11-PMK.05-2020"]),
    ("Undang-Undang Nomor 6", []), ("undang-undang   nomor 007 tahun 2021;", ["UU-7--2021"]), ("SUPER-31/PJ/2009", []), ("x123/PMK.01/2020", []),
    ("Peraturan Pemerintah Pengganti Undang-Undang Nomor 1 Tahun 2020", ["PERPU-1--2020"]), ("KEP - 545/PJ./2000", ["KEP-545-PJ-2000"]), ("", []), ("Nomor 6 Tahun 1983", []),
])
def test_references(text, want):
    assert ["-".join(m[5:]) for m in sorted(relations.marks_in(text), key=lambda m: m[2]) if m[1] == "reference"] == want


def run(spark, units, title=None, known=("uu-6-1983",)):
    statutes_ = spark.createDataFrame([("uu-9-2020", "uu-9-2020", title)] + [(k, k, None) for k in known], "id string, short string, title string")
    units = [("kepala", "before")] * 3 + units  # the last third of the units is where closing clauses stand
    rows = spark.createDataFrame([("uu-9-2020", f"u{i}", i, s, t) for i, (s, t) in enumerate(units)], "id string, unit_id string, seq int, section string, text string")
    return relations.extract(statutes_, rows)


def edges(*a, **k):
    return sorted(((r["source"], r["type"], r["target_key"], r["target_id"], r["confidence"], r["scope"]) for r in run(*a, **k).collect()), key=str)


ME = "uu-9-2020"


@pytest.mark.parametrize("section, text, want", [
    ("penutup", f"Pada saat Undang-Undang ini mulai berlaku, {UU} dicabut dan dinyatakan tidak berlaku.", [(ME, "MENCABUT", "uu-6-1983", "uu-6-1983", 0.95, None)]),
    ("batang_tubuh", f"{UU} dicabut.", [(ME, "MENCABUT", "uu-6-1983", "uu-6-1983", 0.80, None)]),
    ("batang_tubuh", f"{UU} tetap berlaku.", []),
    ("batang_tubuh", f"Izin dicabut. Lihat {UU}.", []),
    ("batang_tubuh", "Undang-Undang Nomor 9 Tahun 2020 dicabut.", []),
    ("kepala", f"{UU} dicabut.", []),
    ("penutup", f"Dengan berlakunya ini, Pasal 4 ayat (2) {PMK} dicabut sebagian.", [(ME, "MENCABUT_SEBAGIAN", "pmk-252-pmk.03-2008", None, 0.75, "Pasal 4 ayat (2)")]),
    ("penutup", f"Dengan berlakunya ini, {UU} dan {PER} dicabut.", [(ME, "MENCABUT", "per-31-pj-2009", None, 0.85, None), (ME, "MENCABUT", "uu-6-1983", "uu-6-1983", 0.85, None)]),
    ("penjelasan", f"{UU} sebagaimana telah diubah dengan Undang-Undang Nomor 16 Tahun 2009", [("uu-16-2009", "MENGUBAH", "uu-6-1983", "uu-6-1983", 0.80, None)]),
    ("penjelasan", f"{UU} {'x ' * 140} sebagaimana telah diubah dengan Undang-Undang Nomor 16 Tahun 2009", []),
    ("penjelasan", f"{UU} sebagaimana telah diubah dengan {'x ' * 100} Undang-Undang Nomor 16 Tahun 2009", []),
    ("penjelasan", f"{UU} sebagaimana telah diubah dengan {UU}", []),
    ("batang_tubuh", f"Beberapa ketentuan dalam {UU} diubah sebagai berikut:", [(ME, "MENGUBAH", "uu-6-1983", "uu-6-1983", 0.93, None)]),
    ("batang_tubuh", f"Beberapa ketentuan dalam {UU} berlaku.", []),
    ("batang_tubuh", f"Beberapa ketentuan dalam {UU} {'x ' * 800} diubah sebagai berikut:", []),
    ("batang_tubuh", f"Beberapa ketentuan pada {UU} sebagaimana telah beberapa kali diubah terakhir dengan Undang-Undang Nomor 16 Tahun 2009 diubah sehingga:",
     [("uu-16-2009", "MENGUBAH", "uu-6-1983", "uu-6-1983", 0.80, None), (ME, "MENGUBAH", "uu-16-2009", None, 0.85, None), (ME, "MENGUBAH", "uu-6-1983", "uu-6-1983", 0.93, None)]),
    ("mengingat", f"{UU}; {PER}", [(ME, "DASAR_HUKUM", "per-31-pj-2009", None, 0.99, None), (ME, "DASAR_HUKUM", "uu-6-1983", "uu-6-1983", 0.99, None)]),
    ("menimbang", f"bahwa untuk melaksanakan ketentuan Pasal 4 {UU}", [(ME, "MELAKSANAKAN", "uu-6-1983", "uu-6-1983", 0.85, "Pasal 4")]),
    ("menimbang", f"bahwa {UU} penting", []),
])
def test_rules(spark, section, text, want):
    assert edges(spark, [(section, text)]) == sorted(want, key=str)


def test_titles_and_short_keys(spark):
    title = "PERUBAHAN KEDUA ATAS PERATURAN MENTERI KEUANGAN NOMOR 252/PMK.03/2008 DAN " + UU
    assert edges(spark, [("kepala", None)], title) == [(ME, "MENGUBAH", "pmk-252-pmk.03-2008", None, 0.97, None)]
    known = spark.createDataFrame([(ME, ME, title), ("a", "pmk-252-2008", None)], "id string, short string, title string")
    empty = spark.createDataFrame([], "id string, unit_id string, seq int, section string, text string")
    assert [r["target_id"] for r in relations.extract(known, empty).collect()] == ["a"]
    two = known.union(spark.createDataFrame([("b", "pmk-252-2008", None)], known.schema))
    assert [r["target_id"] for r in relations.extract(two, empty).collect()] == [None]


def test_a_second_run_changes_nothing(spark):
    found = run(spark, [("mengingat", UU), ("penutup", f"Dengan berlakunya ini, {UU} dicabut."), ("batang_tubuh", f"{UU} dicabut.")])
    once = relations.merge(found.limit(0), found)
    twice = relations.merge(once, found.withColumn("confidence", F.col("confidence") - 0.1).union(found))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(once) == rows(twice) == rows(found) and len(rows(once)) == 2

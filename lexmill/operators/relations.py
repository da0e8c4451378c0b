"""Relations between legal instruments, read from titles and units by rules, resolved and stored.

A table function goes through a unit's text once and emits marks: sentences, trigger phrases and references,
each with its place. Rules then pair marks of one unit by windows over their places (the flags of a sentence,
the nearest mark before or after), so the work is linear in the marks. A rule gives an edge the text that
shows it and a confidence from a ladder. Edges are resolved against the known instruments by their exact key
and then by their short key where only one instrument has it, and merged into what is stored: an edge has one
row whatever number of times the rules run, with the highest confidence.

Defined cases: a null title or text has no marks; a reference of an instrument to itself is no edge; a
reference without a year is none; unresolved targets keep a null id; empty tables give no edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settle
from . import merging

# Instrument names and their codes, trigger phrases, relation types.
NAMES = {
    "undang-undang dasar": "UUD", "undang-undang": "UU", "peraturan pemerintah pengganti undang-undang": "PERPU", "peraturan pemerintah": "PP",
    "peraturan presiden": "PERPRES", "keputusan presiden": "KEPPRES", "peraturan menteri keuangan": "PMK", "keputusan menteri keuangan": "KMK",
    "peraturan direktur jenderal pajak": "PER", "peraturan dirjen pajak": "PER", "keputusan direktur jenderal pajak": "KEP",
    "keputusan dirjen pajak": "KEP", "surat edaran direktur jenderal pajak": "SE", "surat edaran dirjen pajak": "SE",
}
CODES = ("PER", "KEP", "SE", "S", "PENG", "ND", "INS")
TRIGGERS = {
    "partial": ("dicabut sebagian", "sepanjang mengatur", "kecuali ketentuan"),
    "repeal": ("dinyatakan tidak berlaku", "dicabut"),
    "stays": ("tetap berlaku", "dinyatakan masih berlaku"),
    "amended": (
        "sebagaimana telah diubah dengan", "sebagaimana telah diubah terakhir dengan", "sebagaimana telah beberapa kali diubah dengan",
        "sebagaimana telah beberapa kali diubah terakhir dengan",
    ),
    "closing": ("ini mulai berlaku", "dengan berlakunya", "dengan ditetapkannya", "terhitung sejak berlakunya"),
    "omnibus": (
        "beberapa ketentuan dalam", "beberapa ketentuan pada", "beberapa ketentuan dan menambah ketentuan baru dalam",
        "beberapa ketentuan dan menambah ketentuan baru pada",
    ),
    "as follows": ("diubah sebagai berikut", "diubah sehingga"),
    "implements": ("sebagai pelaksanaan ketentuan", "untuk melaksanakan ketentuan", "dalam rangka melaksanakan ketentuan"),
}
AMENDS, REPEALS, REPEALS_PART, BASED_ON, IMPLEMENTS = "MENGUBAH", "MENCABUT", "MENCABUT_SEBAGIAN", "DASAR_HUKUM", "MELAKSANAKAN"

BEFORE, AFTER, TAIL, NEXT = 260, 200, 1_400, 120  # characters that a trigger reaches
_BY_LENGTH = sorted(NAMES, key=len, reverse=True)
_spaced = lambda phrases: "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=len, reverse=True))
_REFERENCE = re.compile(
    rf"\b(?P<name>{_spaced(_BY_LENGTH)})\s+(?:republik\s+indonesia\s+)?nomor\s+(?P<what>\d+[a-z]?\s+tahun\s+\d{{4}}|[^\s,;()]*\d{{4}})(?!\w)"
    rf"|(?<![\w/-])(?P<coded>(?:{'|'.join(CODES)})\s*-\s*\d+[A-Z]?/[^\s,;()/]+/\d{{4}})(?!\w)"
    r"|(?<![\w/-])(?P<bare>\d{1,4}[A-Z]?/[A-Z]{2,6}[^\s,;()]*/(?:19|20)\d{2})(?![\w/])",
    re.IGNORECASE,
)
_TRIGGER = re.compile("|".join(f"(?P<{k.replace(' ', '_')}>{_spaced(p)})" for k, p in TRIGGERS.items()), re.IGNORECASE)
_END = re.compile(r"(?<=[a-z0-9)])\.\s+(?=[A-Z(])|;\s+(?=[a-z0-9]\.|\()")
_SCOPE = re.compile(r"pasal\s+\d+[a-z]?(?:\s+ayat\s+\(\d+\))?(?:\s+huruf\s+[a-z])?", re.IGNORECASE)
MARK = "sentence int, kind string, start int, stop int, raw string, code string, number string, unit_code string, year string"
_KINDS = pa.schema([("sentence", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), *((c, pa.string()) for c in ("raw", "code", "number", "unit_code", "year"))])


def read_reference(m: re.Match) -> tuple | None:
    """raw, code, number, unit, year of a match; none without a number and a year."""
    name, what = m["name"], m["what"] or m["coded"] or m["bare"]
    code = NAMES[" ".join(name.lower().split())] if name else ""
    plain = re.fullmatch(r"(\d+[a-z]?)\s+tahun\s+(\d{4})", what, re.IGNORECASE)
    if plain:
        return m[0], code, plain[1].lstrip("0").upper() or "0", "", plain[2]
    first, *middle, year = "".join(what.split()).upper().split("/")
    prefix, _, number = first.rpartition("-")
    if not re.fullmatch(r"\d+[A-Z]?", number) or not re.fullmatch(r"\d{4}", year):
        return None
    unit = "/".join(middle)
    own = re.match("[A-Z]+", unit)  # a bare number carries its type in the unit
    return m[0], code or prefix or (own[0] if own else ""), number.lstrip("0") or "0", unit.rstrip("."), year


def marks_in(text: str) -> Iterator[tuple]:
    """All marks of a text by their places; the number of the sentence is the last column but for its fields."""
    ends = [m.span() for m in _END.finditer(text)]
    starts, stops = [0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)]
    found = [(m.start(), m.end(), m.lastgroup.replace("_", " "), (m[0], None, None, None, None)) for m in _TRIGGER.finditer(text)]
    for m in _REFERENCE.finditer(text):
        r = read_reference(m)
        if r:
            found.append((m.start(), m.end(), "reference", r))
    found += [(m.start(), m.end(), "scope", (m[0], None, None, None, None)) for m in _SCOPE.finditer(text)]
    at, marked = 0, set()
    for start, stop, kind, fields in sorted(found, key=lambda x: x[:2]):
        while start >= stops[at] and at + 1 < len(starts):
            at += 1
        yield at, kind, start, stop, *fields
        marked.add(at)
    # a sentence without any other mark shows nothing
    yield from ((i, "sentence", starts[i], stops[i], text[starts[i] : stops[i]].strip(), None, None, None, None) for i in sorted(marked))


def marks(rows: DataFrame, carried: list[str], text: str) -> DataFrame:
    """The carried columns and MARK of every mark of a text."""
    names = [f"c{i}" for i in range(len(carried))]
    kinds = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                each = [list(marks_in(t.as_py() or "")) for t in part.column(len(names))]
                place = pa.array([i for i, e in enumerate(each) for _ in e], pa.int64())
                flat = list(zip(*(x for e in each for x in e))) or [()] * len(_KINDS)
                cols = [pa.array(c, k.type) for c, k in zip(flat, _KINDS)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(place) for i in range(len(names))), *cols], names=[*names, *_KINDS.names])

    found = rows.select(*[F.col(c).alias(n) for c, n in zip(carried, names)], text).mapInArrow(run, f"{kinds}, {MARK}")
    return found.withColumnsRenamed(dict(zip(names, carried)))


def key(code: Column, number: Column, unit: Column, year: Column) -> Column:
    return F.lower(F.concat_ws("-", code, number, F.nullif(unit, F.lit("")), year))


def short_key(code: Column, number: Column, year: Column) -> Column:
    return F.lower(F.concat_ws("-", code, number, year))


def _target() -> list[Column]:
    c = [F.col(x) for x in ("code", "number", "unit_code", "year")]
    return [F.col("raw").alias("target"), key(*c).alias("target_key"), short_key(c[0], c[1], c[3]).alias("target_short")]


def from_titles(statutes: DataFrame) -> DataFrame:
    """An amending or repealing title names one instrument: the first reference in it (id, title)."""
    said = F.upper(F.coalesce("title", F.lit("")))
    kind = F.when(said.rlike(r"\bPENCABUTAN\b"), REPEALS).when(said.rlike(r"\bPERUBAHAN\b"), AMENDS)
    asked = statutes.withColumn("type", kind).where("type is not null")
    found = marks(asked, ["id", "type", "title"], "title").where("kind = 'reference'")
    first = merging.first_of_each(found, ["id", "type", "title"], [F.col("start")])
    return first.select(F.col("id").alias("source"), "type", *_target(), F.left("title", F.lit(400)).alias("evidence"), F.lit(None).cast("string").alias("unit_id"),
        F.lit(None).cast("string").alias("scope"), F.lit(0.97).alias("confidence"), F.lit("title").alias("rule"))


def _edge(source: Column, kind: Column, evidence: Column, confidence: Column, rule: str, scope: Column | None = None) -> list[Column]:
    return [
        source.alias("source"), kind.alias("type"), *_target(), evidence.alias("evidence"), F.col("unit_id"),
        (F.lit(None) if scope is None else scope).cast("string").alias("scope"), F.round(confidence, 2).alias("confidence"), F.lit(rule).alias("rule"),
    ]


def from_closing(found: DataFrame) -> DataFrame:
    """A sentence of the body that repeals and refers. Confidence falls for lists, for a reference behind "as
    amended by", for parts, outside a closing clause, and before the last third of the units."""
    sentence = Window.partitionBy("id", "unit_id", "sentence")
    has = lambda kind: F.max(F.col("kind") == kind).over(sentence)
    earlier = sentence.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.where(F.col("section").isin("penutup", "batang_tubuh")).withColumn("other", (F.col("kind") == "reference") & (key(*[F.col(c) for c in ("code", "number", "unit_code", "year")]) != F.col("id")))
    whole = F.first(F.when(F.col("kind") == "scope", F.col("raw")), ignorenulls=True).over(sentence.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select(
        "*", has("repeal").alias("repeals"), has("partial").alias("partly"), has("stays").alias("stays"), has("closing").alias("closes"),
        F.count_if("other").over(sentence).alias("refs"), whole.alias("part"),
        F.max(F.when(F.col("kind") == "sentence", F.col("raw"))).over(sentence).alias("said"),
        F.last(F.when(F.col("kind") == "amended", F.col("stop")), ignorenulls=True).over(earlier).alias("amended_at"),
    ).where("other AND (repeals OR partly) AND NOT (stays AND NOT repeals)")
    amender = F.coalesce(F.col("start") - F.col("amended_at") < NEXT, F.lit(False))
    confidence = F.when(amender, 0.70).when(F.col("refs") > 1, 0.85).otherwise(0.95)
    confidence = F.when(F.col("partly"), F.least(confidence, F.lit(0.75))).otherwise(confidence)
    confidence = confidence - F.when(F.col("closes"), 0.0).otherwise(0.15) - F.when(F.col("place") >= 0.7 * F.col("n_units"), 0.0).otherwise(0.10)
    kind = F.when(F.col("partly"), REPEALS_PART).otherwise(REPEALS)
    return rows.select(*_edge(F.col("id"), kind, F.left("said", F.lit(600)), F.greatest(confidence, F.lit(0.05)), "closing", F.when(F.col("partly"), F.col("part"))))


def from_amended(found: DataFrame) -> DataFrame:
    """"X as amended by Y": the edge runs from Y, the first reference behind the phrase, to X, the last before it."""
    unit = Window.partitionBy("id", "unit_id").orderBy("start", "stop")
    fields = ["raw", "code", "number", "unit_code", "year", "start", "stop"]
    ref = F.when(F.col("kind") == "reference", F.struct(*fields))
    rows = found.where(F.col("kind").isin("reference", "amended"))
    rows = rows.withColumn("before", F.last(ref, ignorenulls=True).over(unit.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("behind", F.first(ref, ignorenulls=True).over(unit.rowsBetween(1, Window.unboundedFollowing))).where("kind = 'amended'")
    rows = rows.where((F.col("before.start") >= F.col("start") - BEFORE) & (F.col("behind.stop") <= F.col("stop") + AFTER))
    by = key(*[F.col(f"behind.{c}") for c in ("code", "number", "unit_code", "year")])
    shown = F.concat(F.col("before.raw"), F.lit(" "), F.col("raw"), F.lit(" "), F.col("behind.raw"))
    rows = rows.withColumn("by", by).withColumn("shown", shown).withColumns({c: F.col(f"before.{c}") for c in fields[:5]})
    c = [F.col(x) for x in ("code", "number", "unit_code", "year")]
    return rows.where(key(*c) != F.col("by")).select(*_edge(F.col("by"), F.lit(AMENDS), F.col("shown"), F.lit(0.80), "as amended by"))


def from_omnibus(found: DataFrame) -> DataFrame:
    """"Several provisions in X ... amended as follows", within TAIL characters. X is the first reference; one that
    follows "as amended by" is X's latest amendment and is touched as well, with less confidence."""
    c = ["code", "number", "unit_code", "year"]
    rows = found.where(F.col("section").isin("penutup", "batang_tubuh") & F.col("kind").isin("reference", "amended", "omnibus", "as follows"))
    unit = Window.partitionBy("id", "unit_id").orderBy("start", "stop")
    ahead = unit.rowsBetween(1, Window.unboundedFollowing)
    ref = F.when(F.col("kind") == "reference", F.struct("raw", *c, "start", "stop"))
    place = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("start")), ignorenulls=True).over(ahead)
    # the reference behind each "as amended by" is found first, then both behind the trigger
    rows = rows.withColumn("latest", F.when(F.col("kind") == "amended", F.first(ref, ignorenulls=True).over(ahead)))
    late = F.first(F.when(F.col("kind") == "amended", F.struct("start", "latest")), ignorenulls=True).over(ahead)
    rows = rows.select("*", F.first(ref, ignorenulls=True).over(ahead).alias("first"), place("as follows").alias("tail_at"), late.alias("late")).where("kind = 'omnibus'")
    until = F.col("stop") + TAIL
    rows = rows.where((F.col("tail_at") < until) & (F.col("first.stop") <= until))
    later = F.when((F.col("late.start") < until) & (F.col("late.latest.stop") <= until) & (F.col("late.start") > F.col("first.start")), F.col("late.latest"))
    both = F.array_compact(F.array(F.struct(F.col("first").alias("r"), F.lit(0.93).alias("sure")), F.when(later.isNotNull(), F.struct(later.alias("r"), F.lit(0.85).alias("sure")))))
    shown = F.concat(F.col("raw"), F.lit(" "), F.col("first.raw"))
    rows = rows.select("id", "unit_id", shown.alias("shown"), F.inline(both)).select("id", "unit_id", "shown", "sure", "r.raw", *[F.col(f"r.{x}").alias(x) for x in c])
    return rows.where(key(*[F.col(x) for x in c]) != F.col("id")).select(*_edge(F.col("id"), F.lit(AMENDS), F.col("shown"), F.col("sure"), "omnibus"))


def from_preamble(found: DataFrame) -> DataFrame:
    """Every reference among the legal bases; those of a consideration that says what is implemented."""
    unit = Window.partitionBy("id", "unit_id")
    first = unit.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = found.where(F.col("section").isin("mengingat", "menimbang")).select(
        "*", F.max(F.col("kind") == "implements").over(unit).alias("implements"), F.first(F.when(F.col("kind") == "scope", F.col("raw")), ignorenulls=True).over(first).alias("part")
    )
    rows = rows.where("kind = 'reference' AND (section = 'mengingat' OR implements)")
    base = F.col("section") == "mengingat"
    return rows.select(*_edge(F.col("id"), F.when(base, BASED_ON).otherwise(IMPLEMENTS), F.col("raw"), F.when(base, 0.99).otherwise(0.85), "preamble", F.when(~base, F.col("part"))))


def resolved(edges: DataFrame, statutes: DataFrame) -> DataFrame:
    """edges with target_id: the instrument (id, short) of the exact key, else the only one of the short key."""
    exact = statutes.select(F.col("id").alias("target_key"), F.col("id").alias("exact"))
    alone = statutes.groupBy(F.col("short").alias("target_short")).agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1").drop("n")
    out = edges.join(exact, "target_key", "left").join(alone, "target_short", "left")
    return out.withColumn("target_id", F.coalesce("exact", "only")).drop("exact", "only")


def extract(statutes: DataFrame, units: DataFrame) -> DataFrame:
    """All rules over a corpus. statutes: id, short, title; units: id, unit_id, seq, section, text. One edge for each
    source, target, type and scope, the most confident."""
    n = Window.partitionBy("id")
    rows = units.withColumn("place", F.row_number().over(n.orderBy("seq")) - 1).withColumn("n_units", F.count("*").over(n))
    found = settle(marks(rows, ["id", "unit_id", "section", "place", "n_units"], "text"), "marks")  # texts are read once for all rules
    edges = from_titles(statutes)
    for rule in (from_closing, from_amended, from_omnibus, from_preamble):
        edges = edges.unionByName(rule(found))
    best = merging.first_of_each(edges, ["source", "target_key", "type", "scope"], [F.desc("confidence"), F.col("rule"), F.col("unit_id"), F.col("evidence")])
    return resolved(best, statutes)


def merge(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """What is stored after a run: new edges are added, known ones keep the higher confidence and its evidence."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(edges.select(stored.columns).withColumn("_new", F.lit(1)))
    return merging.first_of_each(both, ["source", "target_key", "type", "scope"], [F.desc("confidence"), F.col("_new")]).drop("_new")

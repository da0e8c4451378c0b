"""Statutes cut into the units that are cited: chapter, part, article, paragraph, letter, number.

A table function goes through a text's lines once. A line's pattern says what it may open; which of these
count, and what stands open at a line, comes from the lines before it. Lines are never rows, so they are
neither shuffled nor sorted.

Sections: the head, the considerations, the legal bases, the body, the explanation; the article that says
when the statute takes effect is the closing one. Ordinals of a decision's orders stand for articles.

Defined cases: a null or blank text has no units; a document without any marker is one unit of its head;
documents are told apart by their key, so rows that share a key are read as one text, one row after the other in the order of their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section names, the words that open them, and the names of the levels.
HEAD, CONSIDERING, RECALLING, BODY, EXPLANATION, CLOSING = "kepala", "menimbang", "mengingat", "batang_tubuh", "penjelasan", "penutup"
SECTIONS = {EXPLANATION: r"penjelasan\b", CONSIDERING: r"menimbang\s*:?", RECALLING: r"mengingat\s*:?", BODY: r"(?:memutuskan|menetapkan)\s*:?"}
ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
ORDINALS = (
    "kesatu", "pertama", "kedua", "ketiga", "keempat", "kelima", "keenam", "ketujuh", "kedelapan", "kesembilan", "kesepuluh", "kesebelas",
    "kedua belas", "ketiga belas", "keempat belas", "kelima belas", "keenam belas", "ketujuh belas", "kedelapan belas", "kesembilan belas",
    "kedua puluh",
)
EFFECT = r"(?i)mulai\s+berlaku\s+(?:pada\s+)?(?:tanggal\s+)?(?:diundangkan|ditetapkan|\d{1,2}\s+(?:\w+\s+\d{4}|\(\w+\)\s+\w+))"

#: From the highest down: pattern of the line (label, then what follows it).
LEVELS = {
    "chapter": r"(?i)^bab\s+([ivxlc]+)\b(.*)$",
    "part": r"(?i)^((?:bagian\s+\w+|paragraf\s+\d+)\b.*)()$",
    "article": rf"(?i)^pasal\s+(\d+[a-z]?|{'|'.join(ROMANS)})\b\s*(.*)$",
    "paragraph": r"^\((\d+[a-z]?)\)\s*(.*)$",
    "letter": r"^([a-z])\.\s+(.*)$",
    "number": r"^(\d{1,2})\.\s+(.*)$",
}
DICTUM = rf"(?i)^({'|'.join(o.replace(' ', r'\s+') for o in sorted(ORDINALS, key=len, reverse=True))})\s*(?:(?::\s*(.*))|$)$"


_ENDS = "\\n\\r\u0085\u2028\u2029"  # where the engine's patterns end a line


def _compiled(pattern: str) -> re.Pattern:
    """The pattern as Spark reads it: classes and cases of ASCII letters, boundaries of words in any script."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)").replace(".*", f"[^{_ENDS}]*").replace("$", rf"(?=[{_ENDS}]?\Z)"), re.ASCII)


_SECTIONS = {n: _compiled(f"(?i)^{p}") for n, p in SECTIONS.items()}
_LEVELS = {"dictum": _compiled(DICTUM)} | {n: _compiled(p) for n, p in LEVELS.items()}
_EFFECT, _GAP = _compiled(EFFECT), re.compile("[ \t\n\r]+")
_ARTICLE = re.compile(rf"(?:[0-9]+[A-Z]?|{'|'.join(ROMANS)})\n?\Z")
_NAMES = list(LEVELS)
#: What opening a section or a level closes: the place in LEVELS from which labels go.
_CLOSES = {EXPLANATION: 2, BODY: 3} | {n: i + 1 for i, n in enumerate(_NAMES)}
_UNIT = pa.schema([("seq", pa.int32()), *((c, pa.string()) for c in ("section", *_NAMES, "path", "text"))])


def _squeezed(text: str) -> str:
    return _GAP.sub(" ", text).strip(" ")


@lru_cache(maxsize=1 << 14)
def _opens(line: str) -> tuple[str | None, str, str]:
    """What a line may open, its label, and what follows it."""
    for name, pattern in _SECTIONS.items():
        if pattern.match(line):
            return name, "", _squeezed(pattern.sub("", line)) if name in (CONSIDERING, RECALLING) else ""
    for name, pattern in _LEVELS.items():
        m = pattern.match(line)
        if m:
            return name, _squeezed(m[1]), _squeezed(m[2] or "")
    return None, "", ""


def units_in(text: str) -> list[tuple]:
    """The units with text of one statute, in order: the columns of _UNIT."""
    base, into_body, open_, title = HEAD, False, [""] * len(_NAMES), ""
    found, pieces, section = [], [], HEAD  # found: section, open labels, title, pieces
    for line in text.split("\n"):
        line = _squeezed(line)
        if not line:
            continue
        kind, label, after = _opens(line)
        if kind in SECTIONS or kind == "chapter":  # these open a section wherever they stand
            base, into_body = kind if kind in SECTIONS else BODY, False
        elif kind == "article" and (base in (HEAD, CONSIDERING) or (base == RECALLING and not after)) or kind == "dictum" and base == HEAD:
            into_body = True
        now = BODY if into_body and base in (HEAD, CONSIDERING, RECALLING) else base
        event = kind
        if kind == "dictum":
            event = "article" if now == BODY else None
        elif kind == "article" and after and now == RECALLING:
            event = None
        elif kind in ("paragraph", "letter") and now not in (BODY, EXPLANATION):
            event = None
        elif kind == "number" and now != RECALLING and not (now in (BODY, EXPLANATION) and open_[2]):
            event = None
        if event is None:
            if not found:
                section = now
            pieces.append(line)
            continue
        found.append((section, tuple(open_), title, pieces))
        section, pieces = now, []
        if event in _CLOSES:
            open_[_CLOSES[event] :] = [""] * (len(_NAMES) - _CLOSES[event])
        if event in LEVELS:
            open_[_NAMES.index(event)] = label.upper() if kind in ("dictum", "chapter") else label
        if event == "chapter":
            title = label.upper() + (f" {after}" if after else "")
        if after and event not in ("chapter", "part"):
            pieces.append(after)
    found.append((section, tuple(open_), title, pieces))
    rows, closing = [], None
    for section, labels, title, pieces in found:
        body = " ".join(pieces).lstrip(": ").strip(" ")
        if body:
            rows.append((section, labels, title, body))
            if section == BODY and _EFFECT.search(body):
                closing = labels[2]
    out = []
    for seq, (section, (chapter, part, article, paragraph, letter, number), title, body) in enumerate(rows, 1):
        named = article and ("Pasal " if _ARTICLE.match(article.upper()) else "Diktum ") + article
        steps = (chapter and f"BAB {title}", part, named, paragraph and f"ayat ({paragraph})", letter and f"huruf {letter}", number and f"angka {number}")
        path = " > ".join(filter(None, steps)) or section
        labels = (x or None for x in (chapter, part, article, paragraph, letter, number))
        out.append((seq, CLOSING if section == BODY and article == closing else section, *labels, path, body))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[str]]]:
    """Batches of key, text, same with the places and texts to be read; rows of one key follow each other."""
    several, key, first = [], None, None
    for b in batches:
        places, texts = [], []
        for i, (t, same) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if same == 1:
                places.append(i)
                texts.append(t)
                continue
            k = b.column(0)[i].as_py()
            if several and k != key:
                yield first, [0], ["\n".join(sorted(several))]
                several = []
            if not several:
                key, first = k, b.slice(i, 1)
            several.append(t)
            if len(several) == same:
                yield first, [0], ["\n".join(sorted(several))]
                several = []
        for at in range(0, len(places), 500):
            yield b, places[at : at + 500], texts[at : at + 500]
    if several:
        yield first, [0], ["\n".join(sorted(several))]


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, section, the six levels (null where not open), path, text of each unit with text."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # brings rows of one key together; where docs come by their key from a join, nothing is shuffled or sorted for it
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, places, texts in _texts(batches):
            each = [units_in(t) for t in texts]
            place = pa.array([i for i, e in zip(places, each) for _ in e], pa.int64())
            flat = list(zip(*(u for e in each for u in e))) or [()] * len(_UNIT)
            cols = [pa.array(c, f.type) for c, f in zip(flat, _UNIT)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), *cols], names=["key", *_UNIT.names])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, seq int, {', '.join(f'{n} string' for n in _UNIT.names[1:])}")


def unit_id() -> Column:
    """The key, then the section unless it is the body, then the labels from the article down; the unit's number
    where there is none of them."""
    names = {"article": "pasal-", "paragraph": "ayat-", "letter": "huruf-", "number": "angka-"}
    labels = F.concat_ws("-", *[F.when(F.col(n).isNotNull(), F.concat(F.lit(p), F.col(n))) for n, p in names.items()])
    labels = F.concat_ws("-", F.when(F.col("section") != BODY, F.col("section")), F.nullif(labels, F.lit("")))
    return F.concat(F.col("key").cast("string"), F.lit("#"), F.when(labels == "", F.concat(F.lit("blok-"), F.col("seq"))).otherwise(labels))

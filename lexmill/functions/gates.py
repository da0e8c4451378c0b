"""Whether a question belongs to the domain, sentences that spare abbreviations, periods and rate tables in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parsing
from . import text as T

# Weights of the signals, the least score, the names of months.
STRONG, WEAK, AGAINST, LEAST = 35, 8, -35, 25
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")


def domain_gate(text: Column, strong: dict[str, str], weak: dict[str, str], against: dict[str, str], override: tuple[str, ...]) -> Column:
    """in_scope, score (0 to 100), signals, exclusions. Signals are patterns by name. A question is in scope with a
    strong signal and enough score, unless something speaks against it and no overriding signal is there."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    found = lambda table: F.array_compact(F.array(*[F.when(said.rlike(p), F.lit(n)) for n, p in table.items()]).cast("array<string>"))
    s, w, a = found(strong), found(weak), found(against)
    score = STRONG * F.size(s) + WEAK * F.size(w) + AGAINST * F.size(a)
    blocked = (F.size(a) > 0) & ~F.arrays_overlap(s, F.array(*map(F.lit, override)))
    in_scope = (F.length(said) >= 3) & (F.size(s) > 0) & ~blocked & (score >= LEAST)
    return F.struct(in_scope.alias("in_scope"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), F.concat(s, w).alias("signals"), a.alias("exclusions"))


def sentences(text: Column, abbreviations: tuple[str, ...] = ("no", "art", "dr", "mr", "mrs", "st", "vs", "etc")) -> Column:
    """Cut after . ! or ? before a capital or a bracket; not behind an abbreviation, a single letter or a number
    of a list, and not inside a number."""
    spared = "".join(rf"(?<!\b{a}\.)(?<!\b{a.capitalize()}\.)" for a in abbreviations)
    cut = F.split(T.squeeze(F.coalesce(text, F.lit(""))), rf"(?<=[.!?]){spared}(?<!\b\p{{L}}\.)(?<!\b[0-9]\.) (?=[\p{{Lu}}(\"'])")
    return F.filter(cut, lambda s: s != "")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int"), F.lit(0))


def period_in(text: Column) -> Column:
    """start and end of the first "day month [year] sampai dengan day month year"; null where none can be read."""
    pattern = rf"(?i)\b([0-9]{{1,2}}) ({'|'.join(MONTHS)})(?: ([0-9]{{4}}))? (?:sampai dengan|s\.d\.|-) ([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([0-9]{{4}})\b"
    part = lambda g: F.nullif(F.regexp_extract(T.squeeze(text), pattern, g), F.lit(""))
    whole = lambda g: part(g).try_cast("int")
    safe = lambda d, m, y: F.when(d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1)))), d)
    m1, m2, y2 = _month(part(2)), _month(part(5)), whole(6)
    p = parsing.period(safe(whole(1), m1, F.coalesce(whole(3), y2)), m1, whole(3), safe(whole(4), m2, y2), m2, y2)
    return F.when(p["start"].isNotNull() & p["end"].isNotNull(), p)


def _once(x: Column, use) -> Column:
    """use(x), with x computed once however often use names it."""
    return F.transform(F.array(x), use)[0]


def number(text: Column) -> Column:
    """A number in either convention: of two kinds of separators the last one is the decimal mark; a single kind is
    one only before one or two final digits."""
    return _once(F.regexp_replace(F.trim(text), "[-,. ]+$", ""), _number)


def _number(t: Column) -> Column:
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    both = t.contains(",") & t.contains(".")
    decimal_comma = F.when(both, comma > dot).otherwise(t.rlike(",[0-9]{1,2}$"))
    decimal_dot = F.when(both, dot > comma).otherwise(t.rlike(r"\.[0-9]{1,2}$") & (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) == 1))
    plain = F.when(decimal_comma, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when(decimal_dot, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(t, "[.,]", ""))
    return plain.try_cast("double")


def rate_rows(text: Column) -> Column:
    """place, code, name, value, per of the rows "1. 13.665,00 Dolar Amerika Serikat (USD) per 1" of a text, in
    order; a code counts once, the first time its value can be read."""
    pattern = r"([0-9]{1,3})\. ([0-9][0-9.,]*) ([^()0-9]+?) \(([A-Za-z]{3})\)(?: per ([0-9][0-9.,]*))?"
    names = ("place", "value", "name", "code", "per")
    cut = lambda t: F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(n) for g, n in enumerate(names, 1)])
    read = lambda rows: F.transform(rows, lambda r: F.struct(
        r["place"].cast("int").alias("place"), F.upper(r["code"]).alias("code"), r["name"].alias("name"), number(r["value"]).alias("value"), F.coalesce(number(r["per"]), F.lit(1.0)).alias("per")
    ))
    valued = lambda rows: F.filter(rows, lambda r: r["value"].isNotNull())
    # the rows and their codes side by side, so that neither is read again for each row
    coded = lambda rows: F.struct(rows.alias("rows"), F.transform(rows, lambda r: r["code"]).alias("codes"))
    first = lambda x: F.filter(x["rows"], lambda r, i: F.array_position(x["codes"], r["code"]) == i + 1)
    rows = _once(T.squeeze(F.coalesce(text, F.lit(""))), lambda t: valued(read(cut(t))))
    return _once(_once(rows, coded), first)

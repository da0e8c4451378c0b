"""Fields read from text: numbers, amounts, dates, periods, years, ordinals, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped_number(text: Column) -> Column:
    """A number that groups thousands by full stops and has a comma as decimal mark; null if it is none."""
    return F.replace(F.replace(F.regexp_replace(text, r"\s", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def amount_near(text: Column, anchor: str, window: int = 400) -> Column:
    """The first number in a window after an anchor."""
    at = F.locate(anchor, F.lower(text))
    raw = F.regexp_extract(F.substring(text, at, F.lit(window)), r"([0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?)", 1)
    return F.when((at > 0) & (raw != ""), grouped_number(raw))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def largest_year(text: Column) -> Column:
    return F.array_max(years(text))


def last_year(text: Column, otherwise: Column | None = None) -> Column:
    found = F.try_element_at(years(text), F.lit(-1))
    return found if otherwise is None else F.coalesce(found, otherwise)


def iso_day(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy")) -> Column:
    """The day in one of several forms, as yyyy-MM-dd; blank if in none."""
    days = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(F.date_format(F.coalesce(*days), "yyyy-MM-dd"), F.lit(""))


def period(d1: Column, m1: Column, y1: Column, d2: Column, m2: Column, y2: Column) -> Column:
    """start and end of a period whose start may lack its year: it takes the end's, and the year before if the
    start would then lie after the end."""
    end = F.make_date(y2, m2, d2)
    start = F.make_date(F.coalesce(y1, y2), m1, d1)
    return F.struct(F.when(y1.isNull() & (start > end), F.make_date(y2 - 1, m1, d1)).otherwise(start).alias("start"), end.alias("end"))


# Ordinals of amendments.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def amendment_ordinal(title: Column) -> Column:
    """The number of an amendment in words; 1 for an amendment without one, null for a title that is none."""
    low = F.lower(title)
    place = F.array_position(F.array(*map(F.lit, ORDINALS)), F.regexp_extract(low, rf"\b({'|'.join(ORDINALS)}) amendment\b", 1))
    return F.when(place > 0, place.cast("int")).when(low.rlike(r"\bamendment\b"), F.lit(1))


def code_of(label: Column, codes: dict[str, str]) -> Column:
    """A label's code: by the table, else its capitals' first letters."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.lower(F.trim(label))]
    made = F.upper(F.array_join(F.transform(F.split(F.trim(label), r"\s+"), lambda w: F.left(w, F.lit(1))), ""))
    return F.coalesce(known, made)


def alias_key(kind: Column, number: Column, year: Column) -> Column:
    return F.concat_ws("|", F.upper(kind), number.cast("string"), year.cast("string"))


def region_key(kind: Column, number: Column, year: Column, region: Column) -> Column:
    """Local rules carry their region in the key."""
    place = F.upper(F.regexp_replace(F.trim(region), r"[^A-Za-z0-9]+", "_"))
    return F.concat_ws("-", F.upper(kind), F.when(F.coalesce(place, F.lit("")) != "", place), number.cast("string"), year.cast("string"))


def edge_id(*parts: Column) -> Column:
    """A deterministic id of an edge's content."""
    return F.concat(F.lit("edge:"), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(24)))


def status_label(text: Column) -> Column:
    """Partial before full, since one label holds the other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("partly repealed"), "partial").when(low.contains("not in force") | low.contains("repealed"), "repealed")
        .when(low.contains("amended"), "amended").when(low.contains("in force"), "in force").otherwise("unknown")
    )


def clip(text: Column, length: int) -> Column:
    """At most `length` characters, the last of them an ellipsis where something is cut."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.left(text, F.lit(length - 1))), F.lit("…"))).otherwise(text)


def inline_items(text: Column) -> Column:
    """A block's enumerated items, if it has two marks or more: (a) (b) ..., otherwise the block alone."""
    marked = F.split(text, r"(?=\([a-z0-9]{1,2}\) )")
    return F.when(F.regexp_count(text, F.lit(r"\([a-z0-9]{1,2}\) ")) >= 2, F.filter(F.transform(marked, lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(text))

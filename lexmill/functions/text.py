"""Text normalisers, tokenisers and classifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic in the test corpus' four languages.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "der", "die", "und", "le", "la", "et", "de", "el", "que")


def normalise(text: Column, rewrites: tuple[tuple[str, str], ...] = ()) -> Column:
    """Lower case, phrase rewrites in order, all but letters and digits to one space, trimmed."""
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rewrites, F.lower(text))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, longer_than: int = 1) -> Column:
    """Normalised words over a length that are no stop-words, in order, repeats included."""
    stop = F.array(*map(F.lit, stop_words))
    return F.filter(F.split(normalise(text), " "), lambda x: (F.length(x) > longer_than) & ~F.array_contains(stop, x))


def terms(text: Column, least: int = 3) -> Column:
    """Word-character terms of a least length that are not numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda x: ~x.rlike("^[0-9]+$"))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def compact(text: Column, limit: int) -> Column:
    """Cut at the limit, then back to the last space, with an ellipsis; shorter texts stay."""
    cut = F.regexp_replace(F.left(text, F.lit(limit)), " [^ ]*$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))


def sentences(text: Column) -> Column:
    """Runs up to a full stop, question or exclamation mark."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, squeeze), lambda s: s != "")


def numeric_facts(text: Column) -> Column:
    """Distinct numbers and percentages, a comma read as the decimal mark."""
    found = F.regexp_extract_all(text, F.lit("[0-9]+(?:[.,][0-9]+)?%?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")))))


def keyword_label(text: Column, labels: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The label whose keywords occur most often; the first wins ties, none gives `otherwise`."""
    low = F.lower(text)
    scored = [
        F.struct(reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(k)) for k in words]).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(labels.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise(otherwise)


def strip_html(html: Column) -> Column:
    """Scripts, styles and tags out, the common entities decoded, white space squeezed."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def html_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Distinct targets of href attributes without their fragments."""
    found = F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, "#.*$", "")), lambda u: u != "")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://([^/:?#]+)", 1))


def snippet(text: Column, words: tuple[str, ...], before: int = 40, size: int = 160) -> Column:
    """Text around the first place where one of the words stands; the head if none does."""
    low = F.lower(text)
    places = F.filter(F.array(*[F.locate(w, low) for w in words]), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - before)
    return F.substring(text, start, F.lit(size))


def number(text: Column) -> Column:
    """A number in either convention: the right-most of comma and full stop is the decimal mark if
    one or two digits follow it, the other one groups thousands. Null if it is none."""
    raw = F.regexp_replace(text, "[^0-9.,-]", "")
    decimal = F.regexp_extract(raw, "[.,]([0-9]{1,2})$", 1)
    whole = F.regexp_replace(F.when(decimal != "", F.regexp_replace(raw, "[.,][0-9]{1,2}$", "")).otherwise(raw), "[.,]", "")
    return F.concat(whole, F.when(decimal != "", F.concat(F.lit("."), decimal)).otherwise("")).try_cast("double")

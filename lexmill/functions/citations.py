"""Citations of legal instruments in text, read word by word.

A normalised text is cut where letters meet digits as well, so a citation is a few words in a row: a type,
perhaps a word for "number", a number, perhaps an issuing unit with its own small number, perhaps a word for
"year", a year. A fold over the words carries how far such a row has come.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The instrument types, the words for number and year, and the issuing units.
TYPES = ("uu", "perpu", "pp", "perpres", "pmk", "kmk", "kep", "per", "se")
NUMBER_WORDS = ("nomor", "no")
YEAR_WORDS = ("tahun", "th")
UNITS = ("pmk", "pj")

#: What a row of words has come to: nothing, a type, a word for number, a number, a unit, its number, a word for year.
_NONE, _TYPE, _NO, _NUMBER, _UNIT, _UNIT_NUMBER, _YEAR_WORD = range(7)
_STATE = "struct<at:int,kind:string,number:string,keys:array<string>>"


def words(text: Column) -> Column:
    """Normalised words; letters and digits are words apart."""
    t = F.regexp_replace(T.normalise(F.coalesce(text, F.lit(""))), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    return F.split(t, " ")


def _year(w: Column) -> Column:
    return (F.length(w) == 4) & w.rlike("^[0-9]+$") & F.left(w, F.lit(2)).isin("19", "20")


def _digits(w: Column, most: int) -> Column:
    return (F.length(w) <= most) & w.rlike("^[0-9]+$")


def _key(kind: Column, number: Column, year: Column) -> Column:
    plain = F.ltrim(number, F.lit("0"))
    return F.concat_ws("-", kind, F.when(plain == "", "0").otherwise(plain), year)


def _read(state: Column, w: Column) -> Column:
    """The state after one more word."""
    at, kind = state["at"], state["kind"]
    put = lambda at, kind, number, keys=state["keys"]: F.struct(
        F.lit(at).cast("int").alias("at"), kind.alias("kind"), number.alias("number"), keys.alias("keys")
    )
    none = F.lit(None).cast("string")
    on = lambda *states: at.isin(*states)
    number = state["number"]
    return (
        F.when(on(_NUMBER, _UNIT, _UNIT_NUMBER, _YEAR_WORD) & _year(w), put(_NONE, none, none, F.array_append(state["keys"], _key(kind, number, w))))
        .when(on(_TYPE, _NO) & w.rlike("^[0-9]+$"), put(_NUMBER, kind, w))
        .when(on(_TYPE) & w.isin(*NUMBER_WORDS), put(_NO, kind, none))
        .when(on(_NUMBER, _UNIT, _UNIT_NUMBER) & w.isin(*YEAR_WORDS), put(_YEAR_WORD, kind, number))
        .when(on(_NUMBER) & w.isin(*UNITS), put(_UNIT, kind, number))
        .when(on(_UNIT) & _digits(w, 3), put(_UNIT_NUMBER, kind, number))
        # a unit that is a type as well may have begun a citation of its own
        .when(on(_UNIT) & w.isin(*NUMBER_WORDS), put(_NO, F.lit("pmk"), none))
        .when(w.isin(*TYPES), put(_TYPE, w, none))
        .otherwise(put(_NONE, none, none))
    )


def forward(ws: Column) -> Column:
    """Keys of the citations that name the type first."""
    start = F.struct(F.lit(_NONE).alias("at"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), F.array().cast("array<string>").alias("keys"))
    return F.aggregate(ws, start.cast(_STATE), lambda s, w: _read(s, w).cast(_STATE), lambda s: s["keys"])


def backward(ws: Column) -> Column:
    """Keys of the citations in the legacy order: number, type, number of the unit, year."""
    at = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - 4, F.lit(0))),
        lambda i: _digits(F.get(ws, i), 4) & F.get(ws, i + 1).isin(*TYPES) & _digits(F.get(ws, i + 2), 3) & _year(F.get(ws, i + 3)),
    )
    return F.transform(at, lambda i: _key(F.get(ws, i + 1), F.get(ws, i), F.get(ws, i + 3)))


def signals(text: Column) -> Column:
    """Distinct type-number-year keys of a text, sorted; the legacy order counts alone where it occurs."""
    ws = words(text)
    back = backward(ws)
    return F.array_sort(F.array_distinct(F.when(F.size(back) > 0, back).otherwise(forward(ws))))

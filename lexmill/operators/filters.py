"""Predicates: visibility, scopes, facets, lists of hosts, edges that may serve an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def visible(visibility: Column, owner: Column, tenant: str) -> Column:
    """Public rows and the tenant's own; a blank tenant is refused."""
    if not (tenant or "").strip():
        raise ValueError("a tenant is needed")
    return F.coalesce((visibility == "public") | (owner == tenant), F.lit(False))


def facets(wanted: dict[str, tuple[Column, str, list]]) -> Column:
    """Each facet with wanted values (column, default for null, values) holds one of them, without regard
    to case; a facet without values holds all."""
    tests = []
    for column, default, values in wanted.values():
        names = [str(v).strip().lower() for v in values if str(v).strip()]
        if names:
            tests.append(F.lower(F.coalesce(column.cast("string"), F.lit(default))).isin(names))
    return all_of(tests)


def between_or_open(value: Column, low: int | None, high: int | None) -> Column:
    """A null value passes either bound."""
    tests = []
    if low is not None:
        tests.append(F.coalesce(value, F.lit(9999)) >= low)
    if high is not None:
        tests.append(F.coalesce(value, F.lit(0)) <= high)
    return all_of(tests)


def listing(columns: dict[str, Column], like: dict[str, str] | None = None, equal: dict[str, object] | None = None, filled: tuple[str, ...] = ()) -> Column:
    """The predicates that a listing asks for: substrings without regard to case, equal values, filled columns."""
    tests = [F.contains(F.lower(columns[c]), F.lit(v.lower())) for c, v in (like or {}).items() if v]
    tests += [columns[c] == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.coalesce(columns[c].cast("string"), F.lit("")) != "" for c in filled]
    return all_of(tests)


def secure_host(url: Column, suffixes: tuple[str, ...]) -> Column:
    """https only, and the host is one of the suffixes or ends with a dot and one of them."""
    h = text.host(url)
    return url.startswith("https://") & any_of([(h == s) | h.endswith("." + s) for s in suffixes])


def in_scope(record: dict[str, Column], scope: dict[str, object]) -> Column:
    """Equal in every part of the scope; a part that the scope leaves out is null in the record too."""
    return all_of([record[c].eqNullSafe(F.lit(v)) for c, v in scope.items()])


def answerable(eligible: Column, verified: Column, flags: Column) -> Column:
    return F.coalesce(eligible & verified & (F.size(flags) == 0), F.lit(False))


def serving(edge: dict[str, Column], least: float = 0.92) -> Column:
    """An edge that may reach an answer: both ends known and different, verified, confident, with evidence and
    without a conflict; an edge that changes its target comes neither from a lower rank nor an older year."""
    sane = ~((edge["src_rank"] > edge["dst_rank"]) | (edge["src_year"] < edge["dst_year"]))
    return F.coalesce(
        edge["src"].isNotNull() & edge["dst"].isNotNull() & (edge["src"] != edge["dst"]) & edge["verified"] & (edge["confidence"] >= least)
        & (F.coalesce(edge["conflict"], F.lit("")) == "") & (F.coalesce(edge["evidence"], F.lit("")) != "") & (~edge["changes"] | F.coalesce(sane, F.lit(True))),
        F.lit(False),
    )


def meaningful_key(key: Column, placeholders: tuple[str, ...], least: int = 4) -> Column:
    """Long enough after normalising, and no placeholder."""
    k = text.normalise(key)
    return (F.length(k) >= least) & ~k.isin(list(placeholders))


def covers(body: Column, needle: Column, tokens: Column, share: float = 0.6) -> Column:
    """The body holds the needle, or at least a share of the tokens (and one)."""
    low = F.lower(body)
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    enough = (F.size(tokens) > 0) & (hits >= F.greatest(F.lit(1), F.ceil(F.size(tokens) * share)))
    return F.contains(low, F.lower(needle)) | enough


HASH = "^(sha256:)?[a-f0-9]{64}$"


def trusted(score: Column, least: float, verified: Column, digest: Column, locator: Column, allowed: Column) -> Column:
    return F.coalesce((score >= least) & verified & digest.rlike(HASH) & (F.coalesce(locator.cast("string"), F.lit("")) != "") & allowed, F.lit(False))

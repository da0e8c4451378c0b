"""Fields of a web page: from its markup, and from JSON that scripts of it hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

_BLOCK = r'(?is)<script\b[^>]*\btype\s*=\s*["\']?application/(?:[a-z.+-]*\+)?json["\']?[^>]*>(.*?)</script>'


def attribute(html: Column, tag: str, name: str) -> Column:
    """The attribute's value of the first such tag, null where there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\b{name}\s*=\s*[\"']([^\"'>]*)", 1), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of a name or property, whatever the order of its attributes."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def inner(html: Column, tag: str) -> Column:
    """The text inside the first such tag, without markup."""
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(T.strip_html(found), F.lit(""))


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block_no, body, json (a variant; null where the block is no JSON)."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_BLOCK), F.lit(1))).alias("block_no", "body"))
    return each.withColumn("json", F.try_parse_json("body"))


def first_of(json: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    """The value at the first path that is there and can be read as the kind."""
    return F.coalesce(*[F.try_variant_get(json, p, kind) for p in paths])


def fields(pages: DataFrame, key: str, html: str, paths: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """key and a column for each name, from the first block that has it, one row for each page, null where no
    block has it; and what was routed aside: key, block_no, reason, body of the blocks that could not be read."""
    each = blocks(pages, key, html)
    found = each.where("json IS NOT NULL")
    values = [F.struct(F.col("block_no"), first_of(F.col("json"), p).alias("v")) for p in paths.values()]
    g = found.select(key, *[F.when(v["v"].isNotNull(), v).alias(n) for n, v in zip(paths, values)]).groupBy(key).agg(*[F.min(n)["v"].alias(n) for n in paths])
    blank = F.trim("body") == ""
    aside = each.where("json IS NULL").select(key, "block_no", F.when(blank, "empty").otherwise("malformed").alias("reason"), "body")
    return pages.select(key).join(g, key, "left"), aside

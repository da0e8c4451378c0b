"""Claims and their citations: marker parsing, support by token overlap, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Least share of a claim's tokens that a source must have.
LEAST_SUPPORT = 0.22
LEAST_COVERAGE = 0.8


def markers(answer: Column) -> Column:
    """Distinct ids in markers of the form [S:id]."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[S:([A-Za-z0-9_-]+)\]"), F.lit(1))))


def malformed(answer: Column) -> Column:
    """How many bracketed markers begin like a citation and are none."""
    return F.regexp_count(answer, F.lit(r"\[S[^\]]*\]")) - F.regexp_count(answer, F.lit(r"\[S:[A-Za-z0-9_-]+\]"))


def support(claims: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """key, source_id, support: the source that has most of a claim's distinct tokens, ties by id.
    claims: key, body; sources: source_id, body. Only pairs with a common token are formed."""
    c = claims.select(*key, F.array_distinct(text.tokens(F.col("body"))).alias("ts"))
    c = c.select(*key, F.size("ts").alias("n"), F.explode("ts").alias("token"))
    s = sources.select("source_id", F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token"))
    pairs = c.join(s, "token").groupBy(*key, "n", "source_id").agg(F.count("*").alias("common"))
    w = Window.partitionBy(*key).orderBy(F.desc("common"), "source_id")
    best = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(*key, "source_id", (F.col("common") / F.col("n")).alias("support"))


def validate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, claims, cited, unknown, malformed, supported, coverage, valid.

    claims: answer_id, claim_id, body with markers; sources: source_id, body, eligible. A claim is
    supported if one of its known and eligible sources has enough of its tokens."""
    c = claims.select("answer_id", "claim_id", "body", markers(F.col("body")).alias("ids"), malformed(F.col("body")).alias("bad"))
    plain = c.withColumn("body", F.regexp_replace("body", r"\[S[^\]]*\]", " "))
    asked = plain.select("answer_id", "claim_id", "body", F.explode("ids").alias("source_id"))
    known = asked.join(sources.select("source_id", "eligible", F.col("body").alias("source")), "source_id", "left")
    has = F.array_distinct(text.tokens(F.coalesce("source", F.lit(""))))
    wants = F.array_distinct(text.tokens(F.col("body")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(wants, has)), F.size(wants)), F.lit(0.0))
    per = known.groupBy("answer_id", "claim_id").agg(
        F.count_if(F.col("source").isNull() | ~F.col("eligible")).alias("unknown"),
        F.bool_or(F.coalesce(F.col("eligible"), F.lit(False)) & (share >= LEAST_SUPPORT)).alias("supported"),
    )
    rows = c.join(per, ["answer_id", "claim_id"], "left")
    out = rows.groupBy("answer_id").agg(
        F.count("*").alias("claims"), F.count_if(F.size("ids") > 0).alias("cited"), F.sum(F.coalesce("unknown", F.lit(0))).alias("unknown"),
        F.sum("bad").alias("malformed"), F.count_if(F.coalesce("supported", F.lit(False))).alias("supported"),
    )
    coverage = F.col("supported") / F.col("claims")
    return out.withColumn("coverage", coverage).withColumn("valid", (F.col("unknown") == 0) & (F.col("malformed") == 0) & (F.col("coverage") >= LEAST_COVERAGE))

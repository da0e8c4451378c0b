"""Scores of records for questions from a cosine of term counts and the terms that their fields hold.

A pair is formed where it shares a token (the cosine) or a field holds one of the question's focus terms;
all others score nothing of their own. Fields are searched by one automaton over all focus terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rule_tables


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def field_hits(focus: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """qid, id, n_<field>: how many focus terms (qid, term) each field of a record (id) holds."""
    texts = records.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("held")) for f in fields])))
    texts = texts.where("held <> ''").select(F.struct("id", "field").alias("key"), "held")
    hits = rule_tables.phrase_hits(texts, "key", "held", focus, "term").select("key.id", "key.field", F.col("phrase").alias("term"))
    met = focus.distinct().join(hits, "term").groupBy("qid", "id")
    return met.agg(*[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in fields])


def pairs(cosines: DataFrame, hits: DataFrame, focus: DataFrame, fields: list[str]) -> DataFrame:
    """qid, id, cosine (0 to 100), n_focus and the hits of every pair with either."""
    n = focus.distinct().groupBy("qid").agg(F.count("*").alias("n_focus"))
    both = cosines.select("qid", "id", F.col("cosine")).join(hits, ["qid", "id"], "full_outer").join(n, "qid", "left")
    return both.select("qid", "id", (100 * F.coalesce("cosine", F.lit(0.0))).alias("cosine"), F.coalesce("n_focus", F.lit(0)).alias("n_focus"), *[F.coalesce(f"n_{f}", F.lit(0)).alias(f"n_{f}") for f in fields])


def decision_score(cosine: Column, n_focus: Column, text: Column, party: Column, number: Column, issue: Column, outcome: Column) -> Column:
    """0 to 100. text, party, number, issue: how many focus terms they hold; outcome: whether it is the one asked."""
    found = 30.0 * text / n_focus + F.when(party > 0, F.least(F.lit(34.0), 22.0 + 8 * party)).otherwise(0.0)
    found = found + F.when(number > 0, 28.0).otherwise(0.0) + F.when(issue > 0, F.least(F.lit(18.0), 8.0 + 5 * issue)).otherwise(0.0)
    score = 0.42 * cosine + F.when(n_focus > 0, found).otherwise(0.0)
    score = score * F.when((n_focus > 0) & (text == 0), 0.35).otherwise(1.0)
    return _clamp(score + F.when(outcome, F.when(n_focus > 0, 8.0).otherwise(20.0)).otherwise(0.0))


def regulation_score(
    cosine: Column, n_focus: Column, text: Column, title: Column, topic: Column, named: Column, numbered: Column, authority: Column, relevance: Column, status: Column, source: Column
) -> Column:
    """0 to 100. topic: it is the question's; named: one holds the other's name; numbered: a number of the question
    stands in the title; authority: the rank of the issuer; relevance: given; status, source: asked for and there."""
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    score = 0.38 * cosine + F.when(n_focus > 0, 26.0 * text / n_focus + on(title > 0, F.least(F.lit(28.0), 12.0 + 5 * title))).otherwise(0.0)
    score = score * F.when((n_focus > 0) & (text == 0), 0.4).otherwise(1.0)
    score = score + on(topic, 14.0) + on(named, 18.0) + on(numbered, 16.0) + 0.65 * authority
    return _clamp(score + F.least(F.lit(8.0), F.greatest(F.lit(0.0), (relevance - 70) / 4)) + on(status, 8.0) + on(source, 6.0))

"""Corrections as a log: applied in order, each with the value it replaced, undone by finding.

A log row says which finding set which field of which row to which value, and its place in the order. What
holds is the base with the last patch that is not undone; nothing is overwritten, so undoing all patches
gives the first table again, and undoing an earlier patch does not disturb a later one. Findings that set one
field of one row to different values are conflicts: the last one holds, and all stay listed.

Defined cases: a patch may set a field to null; patches of unknown rows or fields are kept in the log and
change nothing; equal places are settled by the finding; an empty log leaves the base as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quality

LOG = ["finding", "row", "field", "value", "at"]


def accepted(proposals: DataFrame, least: float) -> DataFrame:
    """The log rows of the proposals (LOG and confidence) that are sure enough."""
    return proposals.where(F.col("confidence") >= least).select(*LOG)


def active(log: DataFrame, undone: DataFrame) -> DataFrame:
    """The log without the patches of undone findings."""
    return log.join(undone.select("finding").distinct(), "finding", "left_anti").select(*LOG)


def state(base: DataFrame, key: str, log: DataFrame) -> DataFrame:
    """The base table with the last active patch of each field; fields are strings."""
    fields = [c for c in base.columns if c != key]
    last = log.groupBy("row", "field").agg(F.max_by(F.struct("value"), F.struct("at", "finding")).alias("v"))
    wide = last.groupBy(F.col("row").alias(key)).agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f"_{f}") for f in fields])
    new = [F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)).alias(f) for f in fields]
    return base.join(wide, key, "left").select(key, *new)


def with_old(base: DataFrame, key: str, log: DataFrame) -> DataFrame:
    """LOG and old: the value that each active patch replaced."""
    fields = [c for c in base.columns if c != key]
    long = base.select(F.col(key).alias("row"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("first")) for f in fields])))
    w = Window.partitionBy("row", "field").orderBy("at", "finding")
    before = F.lag(F.struct("value")).over(w)
    rows = log.join(long, ["row", "field"]).withColumn("before", before)
    return rows.select(*LOG, F.when(F.col("before").isNotNull(), F.col("before.value")).otherwise(F.col("first")).alias("old"))


def conflicts(log: DataFrame) -> DataFrame:
    """row, field, findings, values: how many findings set a field to how many different values, if to several."""
    g = log.groupBy("row", "field").agg(F.count_distinct("finding").alias("findings"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "value"), F.lit(""))).alias("values"))
    return g.where(F.col("values") > 1)


def vote_proposals(findings: DataFrame, votes: DataFrame, field: str) -> DataFrame:
    """Proposals from other sources' verdicts: LOG and confidence, one for each open finding (finding, row, state, at)
    whose row's sources (row, source, verdict) all say the same; they differ or are silent: none."""
    said = votes.where("verdict IS NOT NULL").groupBy("row").agg(F.count_distinct("source").alias("n"), F.min("verdict").alias("value"), F.max("verdict").alias("most"))
    sure = quality.vote(F.col("n"), F.when(F.col("value") != F.col("most"), 1).otherwise(0))
    rows = findings.where("state = 'open'").join(said, "row").withColumn("confidence", sure).where("confidence IS NOT NULL")
    return rows.select("finding", "row", F.lit(field).alias("field"), "value", "at", "confidence")

"""A retriever in stages: expanded terms, a pass over units, a pass over titles, pinned citations, decay along
edges, and places reserved for kinds of records.

Every stage is a function of small tables and bounded for each question: UNITS units, TITLES records by title
alone, DIRECT records that stay, FRONTIER of them whose edges are followed for two hops. Each hop aggregates
its targets before it goes on, so a record that many edges reach is one row.

Defined cases: a question without terms finds only what it cites; scores that tie go by the record; a record
that is reached by a hop from the frontier takes the hop's score, also if it was found directly further down;
edges to unknown records are not followed; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bounds and weights of the stages.
UNITS, TITLES, DIRECT, FRONTIER, ANCHORS = 6_000, 400, 80, 30, 20
TITLE, COVERED, PLACE = 8.0, 32.0, 0.002
ALONE_TITLE, ALONE_COVERED, ALONE = 18.0, 48.0, -12.0
PINNED, DECAY, LINKED = 10_000.0, (0.62, 0.42), 28.0


def expanded(terms: DataFrame, table: DataFrame) -> DataFrame:
    """qid, token: the question's own tokens and what the table (token, added) adds to them, one step."""
    more = terms.join(table, "token").select("qid", F.col("added").alias("token"))
    return terms.select("qid", "token").unionByName(more).where("token <> ''").distinct()


def best_units(hits: DataFrame, terms: DataFrame, most: int = UNITS) -> DataFrame:
    """qid, record, bm25, place, covered from hits (qid, id, record, bm25, token: one row for each term that a unit
    holds): the record's best unit by its place among the question's, and the terms of all its units together."""
    unit = hits.groupBy("qid", "id", "record").agg(F.max("bm25").alias("bm25"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("bm25", 6)), "id")
    kept = unit.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)
    covered = hits.join(kept.select("qid", "id"), ["qid", "id"], "left_semi").select("qid", "record", "token").distinct()
    covered = covered.join(terms, ["qid", "token"], "left_semi").groupBy("qid", "record").agg(F.count("*").alias("covered"))
    best = kept.groupBy("qid", "record").agg(F.min(F.struct("place", "bm25")).alias("b"))
    return best.join(covered, ["qid", "record"], "left").select("qid", "record", "b.bm25", "b.place", F.coalesce("covered", F.lit(0)).alias("covered"))


def titles(terms: DataFrame, records: DataFrame) -> DataFrame:
    """qid, record, overlap: distinct terms that a record's title (array of tokens) holds."""
    each = records.select("record", F.explode(F.array_distinct("title")).alias("token"))
    return terms.join(each, "token").groupBy("qid", "record").agg(F.count("*").alias("overlap"))


def direct(units: DataFrame, named: DataFrame, terms: DataFrame, pinned: DataFrame, records: DataFrame, most: int = TITLES) -> DataFrame:
    """qid, record, score of everything found without edges."""
    n = terms.groupBy("qid").agg(F.count("*").alias("n"))
    own = records.select("record", "own")
    some = units.join(named, ["qid", "record"], "left").join(n, "qid").join(own, "record")
    score = F.col("bm25") + TITLE * F.coalesce("overlap", F.lit(0)) + COVERED * F.col("covered") / F.col("n") + F.col("own") - PLACE * F.col("place")
    some = some.select("qid", "record", score.alias("score"))
    alone = named.join(units.select("qid", "record"), ["qid", "record"], "left_anti").join(n, "qid")
    alone = alone.withColumn("s", ALONE_TITLE * F.col("overlap") + ALONE_COVERED * F.col("overlap") / F.col("n"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("s", 6)), "record")
    alone = alone.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).join(own, "record").select("qid", "record", (F.col("s") + F.col("own") + ALONE).alias("score"))
    fixed = pinned.join(records.select("record"), "record").select("qid", "record", F.lit(PINNED).alias("score"))
    return some.unionByName(alone).unionByName(fixed).groupBy("qid", "record").agg(F.max("score").alias("score"))


def _ranked(rows: DataFrame, by: str = "score") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round(by, 6)), "record")))


def along_edges(found: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """qid, record, score, rank (of the direct ones), hop: the best direct ones and what two hops from the first
    of them reach. edges: a, b, both directions given."""
    first = _ranked(found).where(F.col("rank") <= DIRECT)
    links = edges.select(F.col("a").alias("record"), "b").distinct().join(records.select(F.col("record").alias("b")), "b")
    seen = first.where(F.col("rank") <= FRONTIER).select("qid", "record", "score")
    frontier, reached = seen, None
    for hop, share in enumerate(DECAY, 1):
        step = frontier.join(links, "record").groupBy("qid", F.col("b").alias("record")).agg((F.max("score") * share).alias("score"))
        frontier = step.join(seen.select("qid", "record"), ["qid", "record"], "left_anti")
        seen = seen.unionByName(frontier)
        new = frontier.withColumn("hop", F.lit(hop))
        reached = new if reached is None else reached.unionByName(new)
    both = first.join(reached.select("qid", "record"), ["qid", "record"], "left_anti").select("qid", "record", "score", F.lit(0).alias("hop")).unionByName(reached)
    return both.join(first.select("qid", "record", "rank"), ["qid", "record"], "left")


def selected(rows: DataFrame, records: DataFrame, slots: DataFrame, structural: DataFrame, limit: int) -> DataFrame:
    """qid, record, score, hop, place. Questions with slots (qid, kind, quota) reserve places for kinds: the best of
    each by score, its bonus and LINKED for a structural edge (a, b) to a record of the direct shortlist; the rest
    go by score. The visible order of such questions is by that sum, of the others by score."""
    anchors = rows.where(F.col("rank") <= ANCHORS).select("qid", F.col("record").alias("b"))
    linked = structural.select("a", "b").distinct().join(anchors, "b").select("qid", F.col("a").alias("record")).distinct().withColumn("linked", F.lit(LINKED))
    asked = slots.select("qid").distinct().withColumn("slotted", F.lit(True))
    rows = _ranked(rows.drop("rank")).join(records.select("record", "kind", "bonus"), "record").join(linked, ["qid", "record"], "left").join(asked, "qid", "left")
    rows = rows.withColumn("sum", F.when(F.col("slotted"), F.col("score") + F.coalesce("linked", F.lit(0.0)) + F.col("bonus")).otherwise(F.col("score")))
    by_kind = Window.partitionBy("qid", "kind").orderBy(F.desc(F.round("sum", 6)), "record")
    quota = slots.groupBy("qid", "kind").agg(F.sum("quota").alias("quota"))
    rows = rows.join(quota, ["qid", "kind"], "left").withColumn("reserved", F.coalesce(F.row_number().over(by_kind) <= F.col("quota"), F.lit(False)))
    left = limit - F.count_if("reserved").over(Window.partitionBy("qid"))
    rows = rows.withColumn("left", left).where(F.col("reserved") | (F.col("rank") <= F.col("left")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("sum", 6)), "record"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("qid", "record", F.round("score", 6).alias("score"), "hop", "place")

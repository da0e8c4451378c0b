"""Two-round reranking of records for questions: direct scores, then the neighbours of the best ones.

A record's score for a question is a part of its own (source, state, topic) and what its text, title and
provisions share with the question's terms and phrases; shares only add. So the best records of a question
are among those that share something and the best few of each topic by their own part: no other pair is
formed. The second round adds the records that eligible edges reach from the first round's best, scores them
by the same rule, keeps the best, and says whether the first of them is evidence enough to answer.

Defined cases: a question without terms scores by the records' own part; ties go by id; a question is
answerable only if its best record reaches `gate` and has a text; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rule_tables

# The weights of the score.
COVERAGE, TITLE, PROVISION, PHRASE = 55.0, 13.0, 18.0, 15.0
PINNED, CITED, TOPIC = 460.0, 280.0, 28.0
OFFICIAL, PROVISIONS, READY, ACTIVE, REVOKED = 22.0, 22.0, 18.0, 18.0, -100.0
GATE = 55.0


def own_part(official: Column, provisions: Column, ready: Column, status: Column) -> Column:
    """What a record scores whatever is asked."""
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return on(official, OFFICIAL) + on(provisions, PROVISIONS) + on(ready, READY) + on(status == "active", ACTIVE) + on(status == "revoked", REVOKED)


def _rank(score: Column):
    return Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), "id")


def _shares(asked: DataFrame, records: DataFrame) -> DataFrame:
    """qid, id, body, title, provision, phrase: how many of the question's terms, or phrases, each text holds."""
    texts = records.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("where"), F.col(c).alias("held")) for c in ("body", "title", "provisions")])))
    texts = texts.select(F.struct("id", "where").alias("key"), "held")
    hits = rule_tables.phrase_hits(texts, "key", "held", asked, "term").select("key.id", "key.where", F.col("phrase").alias("term"))
    met = asked.join(hits, "term").where("NOT phrase OR where = 'body'")
    count = lambda where, phrase: F.count_if((F.col("where") == where) & (F.col("phrase") == phrase)).alias("n_phrase" if phrase else f"n_{where}")
    return met.groupBy("qid", "id").agg(count("body", False), count("title", False), count("provisions", False), count("body", True))


def rerank(questions: DataFrame, records: DataFrame, edges: DataFrame, limit: int = 8, start: int = 4, gate: float = GATE) -> DataFrame:
    """qid, id, score, rank, expanded (reached by an edge), answerable.

    questions: qid, topic, terms, phrases, pinned, cited (arrays; keys of records); records: id, key, topic, own, body,
    title, provisions (texts, normalised as the terms are); edges: a, b (ids, both directions given), eligible."""
    one = lambda c, phrase: F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda t: F.struct(t.alias("term"), F.lit(phrase).alias("phrase")))
    asked = questions.select("qid", F.inline(F.concat(one("terms", False), one("phrases", True)))).where("term <> ''")
    sizes = questions.select("qid", F.col("topic").alias("asked_topic"), F.size(F.array_distinct(F.coalesce("terms", F.array().cast("array<string>")))).alias("n_terms"))
    keyed = lambda c: questions.select("qid", F.explode(c).alias("key")).distinct().join(records.select("id", "key"), "key").select("qid", "id")
    pinned, cited = keyed("pinned").withColumn("is_pinned", F.lit(True)), keyed("cited").withColumn("is_cited", F.lit(True))
    shares = _shares(asked, records)
    # the best of each topic by the own part alone: enough for questions that share nothing with them
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("own", 6)), "id")
    strong = records.select("id", "topic", "own").withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(limit, start))
    same = sizes.join(strong.select("id", F.col("topic").alias("asked_topic")), "asked_topic").select("qid", "id")
    over = strong.withColumn(  # a few rows for each topic
        "n", F.row_number().over(Window.orderBy(F.desc(F.round("own", 6)), "id"))
    ).where(F.col("n") <= max(limit, start))
    slots = F.explode(F.sequence(F.lit(1), F.lit(max(limit, start)))).alias("n")
    best = sizes.select("qid", slots).join(over.select("n", "id"), "n").select("qid", "id")
    pairs = shares.select("qid", "id").unionByName(same).unionByName(best).unionByName(pinned.select("qid", "id")).unionByName(cited.select("qid", "id")).distinct()

    def scored(some: DataFrame) -> DataFrame:
        rows = some.join(sizes, "qid").join(records.select("id", "topic", "own", (F.coalesce("body", F.lit("")) != "").alias("has_text")), "id")
        rows = rows.join(shares, ["qid", "id"], "left").join(pinned, ["qid", "id"], "left").join(cited, ["qid", "id"], "left")
        n = lambda c: F.coalesce(f"n_{c}", F.lit(0))
        score = F.when(F.col("n_terms") > 0, COVERAGE * n("body") / F.col("n_terms")).otherwise(0.0) + TITLE * n("title") + PROVISION * n("provisions") + PHRASE * n("phrase")
        score = score + F.when(F.col("is_pinned"), PINNED).otherwise(0.0) + F.when(F.col("is_cited"), CITED).otherwise(0.0)
        return rows.withColumn("score", score + F.when(F.col("topic") == F.col("asked_topic"), TOPIC).otherwise(0.0) + F.col("own"))

    first = scored(pairs).withColumn("n", F.row_number().over(_rank(F.col("score")))).where(F.col("n") <= max(limit, start)).select("qid", "id", "n")
    links = edges.where("eligible").select(F.col("a").alias("id"), "b").distinct()
    reached = first.where(F.col("n") <= start).join(links, "id").select("qid", F.col("b").alias("id")).join(records.select("id"), "id").distinct()
    pool = first.select("qid", "id", F.lit(False).alias("expanded")).unionByName(reached.select("qid", "id", F.lit(True).alias("expanded")))
    pool = pool.groupBy("qid", "id").agg(F.min("expanded").alias("expanded"))
    rows = scored(pool).withColumn("rank", F.row_number().over(_rank(F.col("score")))).where(F.col("rank") <= limit)
    top = F.max(F.when((F.col("rank") == 1) & F.col("has_text"), F.col("score"))).over(Window.partitionBy("qid"))
    return rows.select("qid", "id", F.round("score", 6).alias("score"), "rank", "expanded", F.coalesce(top >= gate, F.lit(False)).alias("answerable"))

"""Rules kept as tables: phrases found in texts by one automaton, and the rules that they fulfil.

`phrase_hits` is the core: which phrases of a table a text holds. Phrases of a checked total size go to
every task as one Aho-Corasick automaton, built once for a worker. A larger table is dealt into parts of that
size, and blocks of texts meet each part: a text is sent once for each part, never once for each phrase.
Rules are joined with the hits on the phrase, so a rule costs what it matches.

Defined cases: phrases and texts are compared in lower case; null and empty phrases match nothing; a null
text holds nothing; repeated phrases count once; empty tables give no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHRASE_BYTES = 16 << 20
TEXTS_A_BLOCK = 2_000
_built: dict[str, object] = {}


def _automaton(phrases: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(p, p)
    if phrases:
        found.make_automaton()
    return found


def _held(automaton, text: str | None) -> list[str]:
    return sorted({p for _, p in automaton.iter(text)}) if text and len(automaton) else []


def phrase_hits(texts: DataFrame, key: str, body: str, phrases: DataFrame, phrase: str = "phrase", most: int = PHRASE_BYTES) -> DataFrame:
    """key, phrase: the distinct phrases that each text holds."""
    asked = phrases.select(F.lower(F.col(phrase)).alias("phrase")).where("phrase <> ''").distinct()
    rows = texts.select(F.col(key).alias("key"), F.lower(F.col(body)).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, phrase string"
    size = asked.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    if size <= most:
        name = uuid.uuid4().hex
        sent = texts.sparkSession.sparkContext.broadcast([r["phrase"] for r in asked.collect()])  # of checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                _built[name] = _automaton(sent.value)
            for b in batches:
                each = [_held(_built[name], t.as_py()) for t in b.column(1)]
                place = pa.array([i for i, e in enumerate(each) for _ in e], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(place), pa.array([p for e in each for p in e], pa.string())], names=["key", "phrase"])

        return rows.mapInArrow(run, out).withColumnRenamed("key", key)
    parts = -(-size // most)
    blocks = max(1, -(-rows.count() // TEXTS_A_BLOCK))
    left = rows.select("*", F.pmod(F.xxhash64("key", F.octet_length("body")), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = asked.select("phrase", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int").alias("of_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("of_block"))

    def meet(some: pa.Table, against: pa.Table) -> pa.Table:
        automaton = _automaton(against.column("phrase").to_pylist())
        each = [_held(automaton, t) for t in some.column("body").to_pylist()]
        place = pa.array([i for i, e in enumerate(each) for _ in e], pa.int64())
        return pa.table({"key": some.column("key").take(place), "phrase": pa.array([p for e in each for p in e], pa.string())})

    return left.groupBy("part", "block").cogroup(right.groupBy("of_part", "of_block")).applyInArrow(meet, out).withColumnRenamed("key", key)


def watch_matches(rules: DataFrame, records: DataFrame, most: int = PHRASE_BYTES) -> DataFrame:
    """rule, id of the records that a watch rule matches.

    rules: rule, resource, citation, topic (null: any), keywords (null or empty: any); records: id, canonical, topic,
    body. The resource equals the id or the canonical key, the citation and one keyword stand in the body."""
    said = lambda c: F.nullif(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    words = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower), lambda k: k != "")
    rules = rules.select("rule", F.nullif("resource", F.lit("")).alias("resource"), said("citation").alias("citation"), F.nullif("topic", F.lit("")).alias("topic"), words.alias("keywords"))
    records = records.select("id", "canonical", F.coalesce("topic", F.lit("general")).alias("record_topic"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    wanted = F.array(F.struct(F.col("citation").alias("phrase"), F.lit(True).alias("cites")))
    keyed = F.transform("keywords", lambda k: F.struct(k.alias("phrase"), F.lit(False).alias("cites")))
    asks = rules.select("rule", F.inline(F.concat(wanted, keyed))).where("phrase IS NOT NULL").distinct()
    hits = phrase_hits(records, "id", "body", asks, most=most)
    met = asks.join(hits, "phrase").groupBy("rule", "id").agg(F.max("cites").alias("cited"), F.max(~F.col("cites")).alias("worded"))
    phrased = rules.where("citation IS NOT NULL OR size(keywords) > 0")
    fits = (F.col("resource").isNull() | F.coalesce((F.col("resource") == F.col("id").cast("string")) | (F.col("resource") == F.col("canonical")), F.lit(False))) & (
        F.col("topic").isNull() | (F.col("topic") == F.col("record_topic"))
    )
    full = (F.col("citation").isNull() | F.col("cited")) & ((F.size("keywords") == 0) | F.col("worded"))
    by_phrase = met.join(phrased, "rule").where(full).join(records.drop("body"), "id").where(fits)
    plain = rules.where("citation IS NULL AND size(keywords) = 0")
    named = records.select("id", "canonical", "record_topic", F.explode(F.array_distinct(F.array_compact(F.array(F.col("id").cast("string"), "canonical")))).alias("resource"))
    by_resource = plain.where("resource IS NOT NULL").join(named, "resource").where(F.col("topic").isNull() | (F.col("topic") == F.col("record_topic")))
    open_ = records.select("id", F.explode(F.array(F.concat(F.lit("="), "record_topic"), F.lit("*"))).alias("kind"))
    by_topic = plain.where("resource IS NULL").withColumn("kind", F.coalesce(F.concat(F.lit("="), "topic"), F.lit("*"))).join(open_, "kind")
    both = by_phrase.select("rule", "id").unionByName(by_resource.select("rule", "id").distinct())
    return both.unionByName(by_topic.select("rule", "id"))


def term_sources(seeds: DataFrame, records: DataFrame, most: int = PHRASE_BYTES) -> DataFrame:
    """term, id, verified: for each term the first verified record whose body holds one of its phrases, else the first
    record at all; null where there is none. seeds: term, phrases; records: id, place, verified, body."""
    asks = seeds.select("term", F.explode("phrases").alias("phrase")).select("term", F.lower("phrase").alias("phrase")).distinct()
    hits = phrase_hits(records, "id", "body", asks, most=most)
    rank = F.struct((~F.coalesce("verified", F.lit(False))).alias("unsure"), "place", "id")
    best = asks.join(hits, "phrase").select("term", "id").distinct().join(records.select("id", "place", "verified"), "id").groupBy("term").agg(F.min(rank).alias("best"))
    return seeds.select("term").distinct().join(best, "term", "left").select("term", F.col("best.id").alias("id"), (~F.col("best.unsure")).alias("verified"))


def expansions(questions: DataFrame, rules: DataFrame, most: int = PHRASE_BYTES) -> DataFrame:
    """qid, kind, added: what the rules add to a question, each once, in the order of the rules.

    questions: qid, text; rules: place, kind (a phrase or a pinned key), triggers, adds. A rule applies where the
    question holds one of its triggers; `at` is the place of the first rule that adds the value, then its own."""
    asks = rules.select("place", "kind", "adds", F.explode("triggers").alias("phrase")).withColumn("phrase", F.lower("phrase"))
    hits = phrase_hits(questions, "qid", "text", asks, most=most)
    fired = hits.join(asks, "phrase").select("qid", "place", "kind", "adds").distinct()
    each = fired.select("qid", "kind", "place", F.posexplode("adds").alias("at", "added"))
    each = each.groupBy("qid", "kind", "added").agg(F.min(F.struct("place", "at")).alias("first"))
    order = Window.partitionBy("qid", "kind").orderBy("first.place", "first.at", "added")
    return each.select("qid", "kind", "added", F.row_number().over(order).alias("at"))

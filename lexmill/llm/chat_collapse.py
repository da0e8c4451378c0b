"""Chat formatting by cumulative-snapshot collapse.

Loggers often store a conversation again after each turn, so that one snapshot is a prefix of a
longer one. Each turn gets a 128-bit hash of its place, role and text; the running XOR of these is
the hash of the prefix that ends there. A conversation whose (length, hash) is a proper prefix of
another is dropped by an anti-join, equal conversations are collapsed to the smallest id, and only
the maximal ones are rendered.

Both sides of the anti-join are distinct before they are shuffled (partial aggregation), so a first
turn or a whole conversation that a third of the rows share costs one row for each task.

Defined cases: turns are ordered by (turn, role, text), nulls first, and their places count from 1;
exactly repeated rows of a conversation count once; a null role or text differs from the empty one
when hashed and is rendered as empty; rows of a null conv_id form one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def keyed(turns: DataFrame) -> DataFrame:
    """key (a struct of conv_id, so that a null one equals itself), turn, role, text without exact
    repeats, dealt by key. The texts are shuffled here and nowhere else: what follows is grouped by
    key, and both of its uses read the same exchange."""
    return turns.select(F.struct("conv_id").alias("key"), "turn", "role", "text").repartition("key").distinct()


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """key, place, n, h1, h2: the rolling hash after each turn."""
    w = Window.partitionBy("key").orderBy("turn", "role", "text")
    t = keyed(turns).select("key", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("key")).alias("n"), "role", "text")
    shape = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    h = [F.xxhash64(F.lit(k), "place", "role", shape, "text", F.length("role"), F.length("text")) for k in (1, 2)]
    run = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("key", "place", "n", F.bit_xor(h[0]).over(run).alias("h1"), F.bit_xor(h[1]).over(run).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id (of the representative), n_turns, n_copies: conversations that are no proper prefix
    of another, equal ones collapsed to the smallest id."""
    p = prefix_hashes(turns)
    whole = p.where("place = n").groupBy("n", "h1", "h2").agg(F.min("key.conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = p.where("place < n").select(F.col("place").cast("long").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies"
    )


def links(turns: DataFrame) -> DataFrame:
    """conv_id, kept_id: for every conversation the maximal one that it is a prefix of or equal to; of several the
    longest, then the smallest id. A prefix that many conversations share is one row before it is joined."""
    p = prefix_hashes(turns)
    kept = maximal(turns).select(F.struct("conv_id").alias("key"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("key.conv_id").alias("kept_id"))).alias("best")
    ends = p.join(kept, "key", "left_semi").groupBy("place", "h1", "h2").agg(best)
    whole = p.where("place = n").select("key", "place", "h1", "h2")
    return whole.join(ends, ["place", "h1", "h2"]).select("key.conv_id", F.col("best.kept_id").alias("kept_id"))


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen conversations as one chat-markup text each."""
    t = keyed(turns).join(chosen.select(F.struct("conv_id").alias("key"), "n_turns", "n_copies"), "key")
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece"))))
    out = t.groupBy("key").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(rows["piece"], "").alias("rendered")
    )
    return out.select("key.conv_id", "n_turns", "n_copies", "rendered", F.length("rendered").cast("long").alias("n_chars"))


def collapse(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns))


def op5_chat_collapse(spark, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return collapse(table(spark, sf_dir, "conversations"))


def chat_snapshot_links(spark, sf_dir: str) -> DataFrame:
    """Which maximal conversation each one is kept in."""
    return links(table(spark, sf_dir, "conversations"))


_PREFIXES = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece FROM t),
p AS (SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(piece, '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS prefix FROM o),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, prefix FROM p WHERE place = n GROUP BY n, prefix)
"""
ORACLE = f"""{_PREFIXES}SELECT conv_id, n AS n_turns, n_copies, prefix AS rendered, length(prefix) AS n_chars FROM w
WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n)
"""
LINKS = f"""{_PREFIXES}, m AS (SELECT conv_id, n FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n)),
b AS (SELECT prefix, arg_min(conv_id, (-n, conv_id)) AS kept_id FROM (SELECT p.prefix, m.conv_id, m.n FROM p JOIN m ON m.conv_id = p.conv_id) GROUP BY prefix)
SELECT p.conv_id, kept_id FROM p JOIN b USING (prefix) WHERE place = n
"""

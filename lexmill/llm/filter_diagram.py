"""Audit of how filters interact: what each step of every order of the filters removes.

Each document has a failure mask, one bit for each filter. Masks are counted by part in Spark, so a
part has at most 2 ** filters of them. A part's masks become a decision diagram: a level for each
filter, a node for each distinct rest of the function, leaves that hold counts (documents, good ones,
toxic ones), and in every node the sum of its leaves. Orders are visited by plain changes, each one a
swap of two adjacent levels that touches no node of other levels. For every order the path that passes
all filters carries what is kept after each step, and the failing child of its nodes what is removed.

Filter E compares whole texts over the whole table: texts meet by their SHA-256, and each group is
counted by its part, mask and labels before it meets, so a text that a third of the rows hold is a few
rows there.

Defined cases: a null text is empty; a null part is the empty string; a null doc_id is larger than all
others and has no labels, so copies with null ids fail E where an id is known, and pass where none is;
rows of one doc_id are each counted and do not fail E through one another; a doc_id with several labels
is good or toxic if any of them says so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_GAP, table

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
_SALTS = 1024


def failures(docs: DataFrame, part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bits of A to D), sha (of the text)."""
    d = docs.select("doc_id", F.coalesce(part_col, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    n, upper = F.size("words"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = (
        n < 100,
        100 * F.size(F.array_distinct("words")) < 80 * n,
        100 * upper > 10 * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return d.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, mask (bits of A to E), docs, good, toxic: one row for each mask of a part."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # null ids have no labels; their salt keeps them out of one task
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(_SALTS))).otherwise(F.lit(0))
    each = failures(docs, part_col).withColumn("salt", salt).repartition("doc_id", "salt")
    each = each.groupBy("doc_id", "salt", "sha", "part", "mask").agg(F.count("*").alias("n"))
    each = each.join(flags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    none = F.lit(0)
    texts = each.groupBy("sha", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")).agg(
        F.sum("n").alias("docs"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    )
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("sha")))
    passed = F.when(F.col("least").isNull(), F.col("docs")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(
        F.struct(F.col("mask"), passed.alias("docs")),
        F.struct((F.col("mask") + F.lit(1 << COPY)).alias("mask"), (F.col("docs") - passed).alias("docs")),
    )
    rows = texts.select("part", "good", "toxic", F.inline(both)).where("docs > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic")
    )


class Node:
    """A rest of the function: children where the level's filter passes and fails, and the sums of its leaves."""

    __slots__ = ("passing", "failing", "sums")

    def __init__(self, passing: Node | None, failing: Node | None, sums: tuple | None = None):
        self.passing, self.failing = passing, failing
        self.sums = sums or tuple(map(sum, zip(sums_of(passing), sums_of(failing))))


def sums_of(node: Node | None) -> tuple:
    return node.sums if node else (0, 0, 0)


class Diagram:
    """A reduced diagram over masks, level by level; a rest without documents has no node."""

    def __init__(self, filters: str, counts: dict[int, tuple]):
        self.order = list(filters)
        self.levels: list[dict] = [{} for _ in filters]
        self.leaves: dict[tuple, Node] = {}
        self.root = self._build(0, counts)

    def _build(self, level: int, counts: dict[int, tuple]) -> Node | None:
        if not counts:
            return None
        if level == len(self.order):
            (sums,) = counts.values()
            return self.leaves.setdefault(sums, Node(None, None, sums))
        bit = 1 << level
        sides = [self._build(level + 1, {m: c for m, c in counts.items() if bool(m & bit) == side}) for side in (False, True)]
        return self._node(self.levels[level], *sides)

    @staticmethod
    def _node(level: dict, passing: Node | None, failing: Node | None) -> Node | None:
        if passing is None and failing is None:
            return None
        key = id(passing), id(failing)
        if key not in level:
            level[key] = Node(passing, failing)
        return level[key]

    def swap(self, i: int) -> None:
        """Exchanges levels i and i + 1. A node of level i keeps its identity, as it stays the same function,
        so nothing above it changes; its children are shared anew."""
        below: dict = {}
        here = list(self.levels[i].values())
        for u in here:
            (pp, pf), (fp, ff) = ((c.passing, c.failing) if c else (None, None) for c in (u.passing, u.failing))
            u.passing, u.failing = self._node(below, pp, fp), self._node(below, pf, ff)
        self.levels[i], self.levels[i + 1] = {(id(u.passing), id(u.failing)): u for u in here}, below
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def path(self) -> Iterator[tuple[str, tuple, tuple]]:
        """filter, sums kept after it, sums that it removes, along the path that passes all."""
        node = self.root
        for f in self.order:
            failing, node = (node.failing, node.passing) if node else (None, None)
            yield f, sums_of(node), sums_of(failing)


def plain_changes(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i + 1) that lead through all orders of n items."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    downward = True
    while True:
        yield from range(n - 2, -1, -1) if downward else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + downward
        downward = not downward


def all_orders(filters: str, counts: dict[int, tuple]) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order."""
    d = Diagram(filters, counts)
    orders = [("".join(d.order), list(d.path()))]
    for i in plain_changes(len(filters)):
        d.swap(i)
        orders.append(("".join(d.order), list(d.path())))
    first, last, shapley = {}, {}, dict.fromkeys(filters, 0)
    for _, steps in orders:
        first[steps[0][0]], last[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for f, _, gone in steps:
            shapley[f] += gone[0]
    return [
        (order, step, kept[0], gone[0], first[f] - gone[0], last[f], gone[1], gone[2], shapley[f])
        for order, steps in orders
        for step, (f, kept, gone) in enumerate(steps, 1)
    ]


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All steps of all orders, by part, from counted masks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): (int(d), int(g), int(t)) for m, d, g, t in zip(rows["mask"], rows["docs"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(all_orders(filters, masks), columns=[c.split()[0] for c in STEPS.split(", ")[1:]])
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(run, STEPS)


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    return steps(mask_counts(docs, labels, part_col))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_W = r"[\x20\x09-\x0D]+"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
w AS (SELECT d.*, least, list_filter(regexp_split_to_array(d.t, '{_W}'), lambda x: x <> '') AS ws FROM d JOIN f ON d.t = f.t),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
   100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, least IS NOT NULL)] AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier FROM o, x),
r AS (SELECT part, o, step, f,
  sum(CASE WHEN NOT fails[f] AND NOT coalesce(list_bool_or([fails[e] FOR e IN earlier]), FALSE) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or([fails[e] FOR e IN earlier]), FALSE) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[f] AND coalesce(list_bool_or([fails[e] FOR e IN earlier]), FALSE) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[f] AND len([1 FOR b IN fails IF b]) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or([fails[e] FOR e IN earlier]), FALSE) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or([fails[e] FOR e IN earlier]), FALSE) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, o, step, f)
SELECT part, array_to_string([chr(64 + i) FOR i IN o], '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

"""Relation graphs: adjacency, chains, reachability, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.files import settle
from . import edge_blocks


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, incoming: each edge and its reverse."""
    return edges.select("src", "dst", F.lit(False).alias("incoming")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("incoming"))
    )


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """The rows with `no`, from 0 without gaps in the order of the keys however many parts hold them: a part's numbers begin behind the
    counts of the parts before it."""
    each = settle(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("no", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("no", 33).alias("part")
    counts = each.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("no") - F.shiftleft("part", 33)
    return each.withColumn("part", part).join(counts.select("part", before.alias("before")), "part").withColumn("no", rest + F.col("before")).drop("part", "before")


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node (both long for integers), depth: nodes within `hops` undirected edges, breadth first for all seeds at once. Seeds are
    numbered and 64 of them share a row: a bit for each says who has reached the node. Seeds with a neighbour in common
    stand together, whatever their ids, since they reach the same nodes. Edges are packed into blocks once, so a hop
    shuffles packed blocks and its frontier, no edges; bits that were set before are taken away, so pairs appear one by
    one in the result alone. Ids of other types are numbered first."""
    kinds = [edges.schema["src"].dataType, edges.schema["dst"].dataType, seeds.schema["node"].dataType]
    if not all(isinstance(k, IntegralType) for k in kinds):
        return _reach_by_number(edges.select("src", "dst"), seeds.select("node"), hops)
    packed = settle(edge_blocks.blocks(edges), "edges")
    places = settle(edge_blocks.places(packed), "places")
    own = seeds.select(F.col("node").cast("long")).distinct()
    named = settle(numbered(edge_blocks.kin(own, packed, places), "least", "node"), "seeds")
    named = named.select("node", F.shiftright("no", 6).alias("word"), F.expr("shiftleft(1L, int(no % 64))").alias("bit"))
    front = named.select("node", "word", F.col("bit").alias("mask"), F.lit(0).alias("depth"))
    seen, none = front, F.lit(0).cast("long")
    for hop in range(1, hops + 1):
        step = edge_blocks.hop(front, packed, places).withColumn("had", none)
        both = step.unionByName(seen.select("node", "word", none.alias("got"), F.col("mask").alias("had")))
        new = both.groupBy("node", "word").agg(F.bit_or("got").alias("got"), F.bit_or("had").alias("had"))
        new = new.select("node", "word", F.col("got").bitwiseAND(F.bitwise_not("had")).alias("mask"), F.lit(hop).alias("depth"))
        front = settle(new.where("mask <> 0"), "front")
        seen = seen.unionByName(front)
    words = named.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("node").alias("seed"))).alias("seeds"))
    have = F.filter("seeds", lambda x: F.col("mask").bitwiseAND(x["bit"]) != 0)
    return seen.join(words, "word").select(F.explode(have).alias("one"), "node", "depth").select("one.seed", "node", "depth")


def _reach_by_number(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """reach for ids that are no integers: each gets a number and is named again in the result; a null stays one."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).union(seeds).where("name is not null").distinct()
    names = settle(numbered(names, "name"), "names")

    def swapped(rows: DataFrame, c: str, old: str, new: str) -> DataFrame:
        return rows.join(names.select(F.col(old).alias(c), F.col(new).alias("swapped")), c, "left").drop(c).withColumnRenamed("swapped", c)

    edges = swapped(swapped(edges, "src", "name", "no"), "dst", "name", "no")
    out = reach(edges, swapped(seeds, "node", "name", "no"), hops)
    return swapped(swapped(out, "seed", "no", "name"), "node", "no", "name").select("seed", "node", "depth")


def chain_ends(links: DataFrame) -> DataFrame:
    """node, last, steps: where following one outgoing link for each node leads, by pointer
    doubling: a chain of n links takes log2(n) joins. Chains must end; nodes on or before a cycle
    are left out."""
    at = settle(links.select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("steps")), "chain")
    most = max(1, at.count())
    while True:
        on = at.select(F.col("node").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        at = settle(
            at.join(on, "last", "left").select(
                "node", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("open")
            ).where(F.col("steps") <= most), "chain",
        )
        if at.where("open").isEmpty():
            return at.drop("open")
        at = at.drop("open")


def stratified(rows: DataFrame, stratum: str, key: str, quota: int, seed: int) -> DataFrame:
    """A quota from each stratum in a seeded order (a sampling operator)."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("~", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def walk(links: DataFrame, starts: DataFrame) -> DataFrame:
    """node, reached: all nodes that following links (node, next) leads to from each start; every hop joins the
    frontier alone, and pairs that were seen stop, so cycles end."""
    front = settle(starts.select(F.col("node").alias("start"), F.col("node").alias("at")), "walk")
    seen = None
    while True:
        step = front.join(links.withColumnRenamed("node", "at"), "at").select("start", F.col("next").alias("at")).distinct()
        if seen is not None:
            step = step.join(seen, ["start", "at"], "left_anti")
        front = settle(step, "walk")
        if front.isEmpty():
            break
        seen = front if seen is None else settle(seen.unionByName(front), "walked")
    out = seen if seen is not None else front
    return out.select(F.col("start").alias("node"), F.col("at").alias("reached"))


def descendants(links: DataFrame, roots: DataFrame) -> DataFrame:
    """node: all nodes behind any of the roots, by hops over a shrinking frontier of new nodes."""
    near = links.select(F.col("node").alias("at"), F.col("next").alias("node"))
    front, seen = roots.select(F.col("node").alias("at")).distinct(), None
    while True:
        step = front.join(near, "at").select("node").distinct()
        if seen is not None:
            step = step.join(seen, "node", "left_anti")
        new = settle(step, "descendants")
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else settle(seen.unionByName(new), "descendants")
        front = new.withColumnRenamed("node", "at")


def unmet(jobs: DataFrame, key: str, deps: str, done: DataFrame) -> DataFrame:
    """key, unmet: how many of a job's dependencies (an array) are not among the done ones (dep)."""
    each = jobs.select(key, F.explode(deps).alias("dep")).join(done.select("dep", F.lit(True).alias("_done")), "dep", "left")
    return each.groupBy(key).agg(F.count_if(F.col("_done").isNull()).alias("unmet"))

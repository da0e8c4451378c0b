"""Best matches whose score is a base, and a bonus for a value near one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEVELS = 10  # nodes of 1 to 512 cells


def _best(rows: DataFrame, keys: list[str], by: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _cell(value: Column) -> Column:
    return F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), value)))


def nearby_best(left: DataFrame, right: DataFrame, score: Callable[[Column, Column], Column], reach: int, k: int) -> DataFrame:
    """suppkey, custkey, score: of each left row (class, suppkey, a) the k best right rows (class, custkey, b) of its
    class by `score(b, near)`, ties by custkey; near says whether |a - b| < reach, and may only raise a score.

    Pairs are not built. A right row that is not near is among its class's k best by the base, since whatever
    stands before it there stands before it everywhere. For those near, the k best of cells of width 1 and of runs
    of 2, 4 .. 512 cells are kept; the cells that lie within reach as a whole are covered by at most two runs of
    each length, and the values of the two last cells on either side, k rows of each value, are compared themselves.
    Values are told apart up to 9e18; a null a scores 0 with all, so the smallest custkeys are its best."""
    if reach - 2 > 1 << _LEVELS - 1:
        raise ValueError("take more levels")
    right = right.where("class is not null")
    base, bonus = F.round(score(F.col("b"), F.lit(False)), 4), F.round(score(F.col("b"), F.lit(True)), 4)
    valued = right.where("b is not null").select("class", "custkey", "b", bonus.alias("s"), _cell(F.col("b")).alias("cell"))
    order = [F.desc("s"), "custkey"]
    # of one value, and of one cell
    each = _best(valued, ["class", "cell", "b"], ["custkey"], k)
    ones = _best(each, ["class", "cell"], order, k)
    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("level")
    runs = ones.select("class", "custkey", "b", "s", "cell", levels).withColumn("node", F.expr("shiftright(cell, level)"))
    runs = _best(runs, ["class", "level", "node"], order, k).select("class", "level", "node", "custkey", "b")
    edges = each.select("class", F.lit(-1).alias("level"), F.col("cell").alias("node"), "custkey", "b")

    lo, hi = F.col("cell") - (reach - 2), F.col("cell") + (reach - 2)
    asked = [F.struct(F.lit(-1).alias("level"), (F.col("cell") + side * x).alias("node")) for side in (-1, 1) for x in (reach - 1, reach)]
    for level in range(_LEVELS):
        first, last = F.shiftright(lo + ((1 << level) - 1), level), F.shiftright(hi + 1, level) - 1
        for end, odd in ((first, 1), (last, 0)):
            asked.append(F.when((first <= last) & (F.pmod(end, F.lit(2)) == odd), F.struct(F.lit(level).alias("level"), end.alias("node"))))
    own = left.where("class is not null").select("class", "suppkey", "a")
    probes = own.where("a is not null").withColumn("cell", _cell(F.col("a"))).select("class", "suppkey", "a", F.explode(F.array_compact(F.array(*asked))).alias("at"))
    probes = probes.select("class", "suppkey", "a", "at.level", "at.node")
    near = F.coalesce(F.abs(F.col("a") - F.col("b")) < reach, F.lit(False))
    found = probes.join(runs.unionByName(edges), ["class", "level", "node"]).where(near)
    far = _best(right.withColumn("s", base), ["class"], order, k).select("class", "custkey", "b")
    far = own.where("a is not null").join(far, "class").where(~near)
    none = own.where("a is null").join(_best(right, ["class"], ["custkey"], k), "class")
    cols = ["suppkey", "a", "custkey", "b"]
    rows = found.select(cols).unionByName(far.select(cols)).unionByName(none.select(cols))
    rows = rows.select("suppkey", "custkey", F.round(F.when(F.col("a").isNull(), 0.0).otherwise(score(F.col("b"), near)), 4).alias("score"))
    return _best(rows, ["suppkey"], [F.desc("score"), "custkey"], k)

import random

from pyspark.sql import functions as F

from lexmill.operators import comparables


def plain(b, near):
    return 0.0 if b is None else min(96.0, 18 + 42 * (b > 0) + 18 * near + 22 * min(1.0, abs(b) / 10000))


def score(b, near):
    s = F.least(F.lit(96.0), 18 + 42 * (b > 0).cast("int") + 18 * near.cast("int") + 22 * F.least(F.lit(1.0), F.abs(b) / 10000))
    return F.when(b.isNull(), 0.0).otherwise(s)


def test_best_matches_equal_all_pairs(spark):
    draw = random.Random(5)
    left = [(i % 3, i, draw.choice([None, 0.0, 500.0, -500.0, 9999.99, round(draw.uniform(-1500, 11000), 2)])) for i in range(120)]
    right = [(i % 3, i, draw.choice([None, 0.0, 1000.0, 499.99, 500.01, -0.01, round(draw.uniform(-1500, 11000), 2)])) for i in range(300)]
    right += [(2, 900 + i, 3.5e17 * i) for i in range(3)] + [(None, 999, 1.0)]
    left += [(1, 200 + i, float(x)) for i, x in enumerate((-700, 12000, 3.5e17))] + [(7, 300, 1.0), (None, 301, 1.0)]
    got = comparables.nearby_best(
        spark.createDataFrame(left, "class int, suppkey long, a double"), spark.createDataFrame(right, "class int, custkey long, b double"), score, 500, 2
    )
    want = set()
    for c, s, a in left:
        each = [(k, b, abs(a - b) < 500 if a is not None and b is not None else False) for z, k, b in right if z == c is not None]
        value = sorted((-round(0.0 if a is None else plain(b, near), 4), k) for k, b, near in each)
        want |= {(s, k, -v) for v, k in value[:2]}
    assert {tuple(r) for r in got.collect()} == want


def test_pairs_are_not_built(spark):
    n = 4000
    left = spark.range(n).select(F.lit(1).alias("class"), F.col("id").alias("suppkey"), (F.col("id") / 4).alias("a"))
    right = spark.range(n).select(F.lit(1).alias("class"), F.col("id").alias("custkey"), (F.col("id") / 4).alias("b"))
    met = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(b):
        met.add(1)
        return True

    def counted(b, near):
        return F.when(seen(b), score(b, near))

    assert comparables.nearby_best(left, right, counted, 500, 2).count() == 2 * n
    assert met.value < n * 60

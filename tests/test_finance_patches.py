import random

from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.operators import fielded, patches


def worth(xs, r):
    return sum(x / (1 + r) ** i for i, x in enumerate(xs))


def payback(xs):
    total = xs[0] if xs else 0
    for i, x in enumerate(xs[1:], 1):
        before, total = total, total + x
        if total >= 0:
            return i - 1 + (-before / x if x else 0)


def test_rate_of_return_and_payback(spark):
    rng = random.Random(7)
    flows = [[-100.0, 60.0, 60.0], [-100.0, 10.0], [100.0, -60.0, -60.0], [1.0, 2.0], [-1.0, -2.0], [-5.0], [], None, [0.0, 0.0], [-1.0, 5.9]]
    flows += [[-rng.uniform(10, 100)] + [rng.uniform(-5, 60) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(flows)], "i int, xs array<double>")
    got = rows.select("i", scores.rate_of_return(F.col("xs")).alias("r"), scores.payback(F.col("xs")).alias("p"), scores.discounted(F.col("xs"), F.lit(0.1)).alias("w")).collect()
    roots = 0
    for i, r, p, w in map(tuple, got):
        xs = flows[i]
        ends = [worth(xs, e) for e in (-0.99, 5.0)] if xs else [0, 0]
        if xs and len(xs) > 1 and ends[0] * ends[1] < 0:
            roots += 1
            assert abs(worth(xs, r)) < 1e-9 * sum(map(abs, xs)) / min(1, (1 + r) ** len(xs))
            assert worth(xs, r - 1e-9) * worth(xs, r + 1e-9) <= 0
        else:
            assert r is None, xs
        want = payback(xs) if xs else None
        assert p == want or abs(p - want) < 1e-9
        assert (w is None) == (xs is None) and (xs is None or abs(w - worth(xs, 0.1)) < 1e-9)
    assert roots > 40


BASE = [(i, f"a{i}", None if i % 3 == 0 else f"b{i}") for i in range(12)]


def frames(spark, log):
    base = spark.createDataFrame(BASE, "id long, x string, y string")
    return base, spark.createDataFrame(log, "finding string, row long, field string, value string, at long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_patches_in_order_and_undone(spark):
    rng = random.Random(5)
    log = [(f"f{rng.randrange(9)}", rng.randrange(14), rng.choice(["x", "y", "z"]), rng.choice([None, "p", "q", "r"]), n) for n in range(60)]
    base, patch = frames(spark, log)

    def by_loop(gone):
        table, old = {i: {"x": x, "y": y} for i, x, y in BASE}, []
        for f, r, c, v, n in log:
            if f not in gone and r in table and c in table[r]:
                old.append((f, r, c, v, n, table[r][c]))
                table[r][c] = v
        return sorted(((i, t["x"], t["y"]) for i, t in table.items()), key=str), sorted(old, key=str)

    for gone in ((), ("f1",), ("f1", "f4", "f8", "unknown"), tuple(f"f{i}" for i in range(9))):
        live = patches.active(patch, spark.createDataFrame([(g,) for g in gone], "finding string"))
        state, old = by_loop(gone)
        assert rows(patches.state(base, "id", live)) == state
        assert rows(patches.with_old(base, "id", live)) == old
    assert state == sorted(BASE, key=str)  # all undone: the first table
    disputed = {(r["row"], r["field"]) for r in patches.conflicts(patch).collect()}
    assert disputed == {(r, c) for _, r, c, _, _ in log if len({v for _, s, d, v, _ in log if (s, d) == (r, c)}) > 1}


def test_votes_settle_open_findings_only(spark):
    findings = spark.createDataFrame([("a", 1, "open", 1), ("b", 2, "open", 1), ("c", 3, "open", 1), ("d", 4, "closed", 1), ("e", 5, "open", 1), ("g", 6, "open", 1)], "finding string, row long, state string, at long")
    votes = [(1, s, "x") for s in "pq"] + [(2, "p", "x"), (2, "q", "y"), (3, "p", "x"), (4, "p", "x"), (4, "q", "x"), (6, "p", None)] + [(1, "p", "x")]
    got = patches.vote_proposals(findings, spark.createDataFrame(votes, "row long, source string, verdict string"), "f")
    assert sorted((r["finding"], r["value"], r["confidence"]) for r in got.collect()) == [("a", "x", 0.88), ("c", "x", 0.62)]
    assert [r["finding"] for r in patches.accepted(got, 0.88).collect()] == ["a"]


def test_fielded_search(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Café au lait", "tea"), (2, "tea tea tea", "cafe"), (3, None, None), (4, "x", "x y"), (5, "nothing", "here"), (6, "more", "rows")], "id long, body string, title string")
    index = fielded.build(pages, ["body", "title"], f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "CAFE"), (2, "absent"), (3, None)], "qid long, body string")
    best = lambda w: [(r["qid"], r["id"]) for r in fielded.search(spark, index, asked, w, 5).orderBy("qid", "rank").collect()]
    assert best({"body": 9.0, "title": 1.0}) == [(1, 1), (1, 2)] and best({"body": 1.0, "title": 9.0}) == [(1, 2), (1, 1)]

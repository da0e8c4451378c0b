import itertools

from lexmill.llm import filter_diagram

from .conftest import pairs

SPACE = " \t\n\x0b\x0c\r"


def failing(docs):
    """part, set of failing filters, of each (doc_id, text, part)."""
    out = []
    for i, t, part in docs:
        t = t or ""
        for c in SPACE[1:]:
            w = (w if c != "\t" else t).replace(c, " ")
        w = [x for x in w.split(" ") if x]
        ids = [j for j, u, _ in docs if (u or "") == t and j is not None]
        copy = bool(ids) and (i is None or i > min(ids))
        rules = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy)
        out.append((part or "", {f for f, bad in zip("ABCDE", rules) if bad}))
    return out


def brute_force(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    fails, rows = failing(docs), []
    for part in {p for p, _ in fails}:
        mine = [(d[0], f) for d, (p, f) in zip(docs, fails) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        here = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                here.append((
                    "".join(order), step, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None),
                ))
        rows += [(part, *r, shapley[r[0][r[1] - 1]]) for r in here]
    return sorted(rows)


def test_equals_brute_force(spark, odd, small):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, 0), (None, 1, 1), (9, 1, None), (13, 0, 1), (99, 1, 1), (18, 1, 0)]
    table = spark.createDataFrame([(*x, "a") for x in labels], "doc_id long, quality int, toxic int, mask string")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    got = sorted(map(tuple, filter_diagram.audit(odd, table).collect()))
    assert got == brute_force(docs, labels) and len(got) == 1200
    by_source = filter_diagram.audit(small, table, "source")
    want = brute_force([(r["doc_id"], r["text"], r["source"]) for r in small.collect()], labels)
    assert sorted(map(tuple, by_source.collect())) == want


def test_swaps_visit_every_order_and_keep_the_function():
    counts = {0: (5, 1, 0), 3: (2, 0, 1), 12: (2, 0, 1), 31: (7, 7, 7), 16: (1, 1, 1)}
    d, seen = filter_diagram.Diagram("ABCDE", counts), set()
    for i in itertools.chain([None], filter_diagram.plain_changes(5)):
        if i is not None:
            d.swap(i)
        seen.add("".join(d.order))
        for mask, sums in counts.items():
            node = d.root
            for f in d.order:
                node = node.failing if mask >> "ABCDE".index(f) & 1 else node.passing
            assert node.sums == sums
        fresh = filter_diagram.Diagram("".join(d.order), {sum(1 << d.order.index(f) for b, f in enumerate("ABCDE") if m >> b & 1): c for m, c in counts.items()})
        assert [len(x) for x in d.levels] == [len(x) for x in fresh.levels]  # still reduced
    assert len(seen) == 120


def test_known_ids_decide_copies(spark, empty):
    rows = [(None, "x"), (None, "x"), (None, "y"), (4, "y"), (4, "y"), (6, "y")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    last = {r["filter_order"]: r for r in filter_diagram.audit(docs, labels).where("step = 1").collect()}["EABCD"]
    assert (last["part"], last["kept"], last["removed"]) == ("", 4, 2)
    assert filter_diagram.audit(empty, labels).collect() == [] and len(pairs(docs)) == 6

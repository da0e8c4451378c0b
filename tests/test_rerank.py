import random

from lexmill.operators import rerank


def by_loop(questions, records, edges, limit=8, start=4):
    """Every record scored for every question."""
    out = []
    for qid, topic, terms, phrases, pinned, cited in questions:
        terms, phrases = set(terms or []), set(phrases or [])

        def score(r):
            i, key, about, own, body, title, provisions = r
            n = lambda words, text: sum(w in (text or "") for w in words)
            s = 55 * n(terms, body) / len(terms) if terms else 0
            s += 13 * n(terms, title) + 18 * n(terms, provisions) + 15 * n(phrases, body) + own + (28 if about == topic else 0)
            return s + (460 if key in (pinned or []) else 0) + (280 if key in (cited or []) else 0)

        order = lambda rs: sorted(rs, key=lambda r: (-round(score(r), 6), r[0]))
        first = order(records)[: max(limit, start)]
        near = {b for r in first[:start] for a, b, ok in edges if ok and a == r[0]}
        pool = {r[0]: r for r in first} | {r[0]: r for r in records if r[0] in near}
        best = order(pool.values())[:limit]
        answer = bool(best and best[0][4] and score(best[0]) >= rerank.GATE)
        out += [(qid, r[0], round(score(r), 6), n, r[0] not in {x[0] for x in first}, answer) for n, r in enumerate(best, 1)]
    return sorted(out)


def test_equals_scoring_every_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 3)))
    some = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    records = [(i, f"k{i % 40}", rng.choice("xyz"), float(rng.choice([-100, 0, 18, 40, 80])), rng.choice([None, some(12)]), some(3), some(4)) for i in range(60)]
    questions = [(q, rng.choice("xyw"), [word() for _ in range(rng.randrange(5))], rng.choice([None, [word(), "ab c"]]), rng.choice([None, ["k3", "k99"]]), rng.choice([[], ["k7"]])) for q in range(25)]
    edges = [(rng.randrange(60), rng.randrange(70), rng.random() < 0.7) for _ in range(150)]
    got = rerank.rerank(
        spark.createDataFrame(questions, "qid long, topic string, terms array<string>, phrases array<string>, pinned array<string>, cited array<string>"),
        spark.createDataFrame(records, "id long, key string, topic string, own double, body string, title string, provisions string"),
        spark.createDataFrame(edges, "a long, b long, eligible boolean"),
    ).collect()
    assert sorted(map(tuple, got)) == by_loop(questions, records, edges)

import random

import pytest

from lexmill.operators import rule_tables


def words(rng, n, alphabet="abcd"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    return [(i, f"r-{i % 37}", rng.choice(["vat", "income", None]), " ".join(words(rng, rng.randint(0, 30)))) for i in range(200)] + [(900, None, "vat", None), (901, "r-1", "VAT", "Ünï CODE abc")]


@pytest.mark.parametrize("most", [1 << 20, 9_000])
def test_ten_thousand_phrases_equal_a_nested_loop(spark, corpus, most):
    rng = random.Random(1)
    phrases = [*words(rng, 6_000, "abcde"), *(" ".join(words(rng, 2)) for _ in range(4_000)), "ÜNÏ code", "", None]
    texts = spark.createDataFrame([(i, t) for i, _, _, t in corpus], "id long, t string")
    got = {tuple(r) for r in rule_tables.phrase_hits(texts, "id", "t", spark.createDataFrame([(p,) for p in phrases], "phrase string"), most=most).collect()}
    assert got == {(i, p.lower()) for i, _, _, t in corpus for p in phrases if p and t and p.lower() in t.lower()} and len(got) > 2_000


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "id long, t string, phrase string"), spark.createDataFrame([(1, "x", "x")], "id long, t string, phrase string")
    assert rule_tables.phrase_hits(none, "id", "t", some).collect() == rule_tables.phrase_hits(some, "id", "t", none).collect() == []


def test_watch_rules_equal_a_nested_loop(spark, corpus):
    rng = random.Random(2)
    maybe = lambda x, share: x if rng.random() < share else rng.choice([None, ""])
    rules = [
        (i, maybe(rng.choice([f"r-{rng.randrange(40)}", str(rng.randrange(200))]), 0.2), maybe(words(rng, 1)[0].upper(), 0.3), maybe(rng.choice(["vat", "income", "general"]), 0.4),
         rng.choice([None, [], words(rng, 2), [*words(rng, 1), ""]]))
        for i in range(400)
    ]

    def fits(rule, record):
        _, resource, citation, topic, keywords = rule
        i, canonical, about, body = record
        hay, keywords = (body or "").lower(), [k for k in keywords or [] if k]
        return (
            (not resource or resource in (str(i), canonical)) and (not citation or citation.lower() in hay)
            and (not topic or topic == (about or "general")) and (not keywords or any(k.lower() in hay for k in keywords))
        )

    got = rule_tables.watch_matches(
        spark.createDataFrame(rules, "rule long, resource string, citation string, topic string, keywords array<string>"), spark.createDataFrame(corpus, "id long, canonical string, topic string, body string")
    ).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], c[0]) for r in rules for c in corpus if fits(r, c))


def test_terms_take_the_first_verified_source(spark):
    seeds = spark.createDataFrame([("a", ["X y", "zz"]), ("b", ["q"]), ("c", ["nothing"]), ("d", [])], "term string, phrases array<string>")
    records = spark.createDataFrame([(5, 1, False, "x y"), (6, 2, True, "has ZZ"), (7, 3, True, "zz"), (8, 0, None, "q"), (9, 4, False, "q"), (1, 5, True, None)], "id long, place int, verified boolean, body string")
    assert sorted(map(tuple, rule_tables.term_sources(seeds, records).collect())) == [("a", 6, True), ("b", 8, False), ("c", None, None), ("d", None, None)]


def test_expansions_keep_the_order_of_the_rules(spark):
    rules = spark.createDataFrame([(1, "phrase", ["spt masa", "vat return"], ["b", "a"]), (2, "phrase", ["tariff"], ["a", "c"]), (3, "key", ["tariff"], ["uu-1-2000"])], "place int, kind string, triggers array<string>, adds array<string>")
    questions = spark.createDataFrame([(1, "What TARIFF, and the SPT Masa?"), (2, "spt masa vat return"), (3, None), (4, "other")], "qid long, text string")
    assert sorted(map(tuple, rule_tables.expansions(questions, rules).collect())) == [
        (1, "key", "uu-1-2000", 1), (1, "phrase", "a", 2), (1, "phrase", "b", 1), (1, "phrase", "c", 3), (2, "phrase", "a", 2), (2, "phrase", "b", 1),
    ]

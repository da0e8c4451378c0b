import corpus_pipeline as cp
from lexmill.llm import quality_rules, secret_scan

from .conftest import SF, pairs
from .test_document_operators import RANKS, library_ids, unpacked
from .test_near_copies import kept_by_brute_force


def test_stages_take_effect_one_after_another(spark, small):
    docs, seen = small, {}
    for name, f in cp.STAGES[:-1]:
        docs = cp.materialize(f(spark, docs, SF), "test")
        assert docs.columns == small.columns
        seen[name] = dict(pairs(docs))
    kept = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(small), cp.POLICY).where("kept").collect()}
    quality, dedup, cut, clean = seen.values()
    assert set(quality) == kept
    assert sorted(dedup) == kept_by_brute_force(quality.items()) and len(dedup) < len(quality)
    assert set(cut) == set(dedup) and sum(map(len, cut.values())) < sum(map(len, dedup.values()))
    once = set()
    for i in sorted(cut):
        b = dedup[i].encode()
        own = {b[p : p + 50] for p in range(len(b) - 49)}
        assert (len(cut[i]) < len(dedup[i])) == bool(own & once)
        once |= own
    enc = secret_scan.vocabulary(RANKS)
    for i, t in cut.items():
        assert (clean[i] == t) == (not secret_scan.find_spans(t, enc))
    pieces, _ = unpacked(cp.STAGES[-1][1](spark, docs, SF).collect())
    assert {i: [x for _, part in sorted(p) for x in part] for i, p in pieces.items()} == {i: [*library_ids(t), 0] for i, t in clean.items()}


def test_stages_on_the_odd_table(spark, odd):
    docs = odd
    for _, f in cp.STAGES[:-1]:
        docs = cp.materialize(f(spark, docs, SF), "test")
        assert docs.columns == odd.columns and docs.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    kept = dict(pairs(docs))
    assert {1, 9, 10, 11, 17, -5} == kept.keys()  # 2, 3, None and a repeated row are copies of 1
    assert "[SECRET]" in kept[17] and "Abcdef123456XYZ" not in kept[17]
    assert unpacked(cp.STAGES[-1][1](spark, docs, SF).collect())[0].keys() == kept.keys()


def test_run_and_empty(spark, empty, small):
    assert cp.run(spark, SF).count() > 0
    docs = empty.select(small.columns)
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
    assert docs.collect() == []

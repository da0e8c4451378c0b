import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import spelling
from lexmill.llm.fm_index import BidirectionalIndex

from .conftest import pairs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_force(rows):
    count = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c < "\x80" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            at = h % len(r)
            count[r if h % 199 else r[:at] + r[at + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for w in words:
        near[w] = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def result(docs, **k):
    return sorted(map(tuple, spelling.variants(docs, **k).collect()), key=str)


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_all_words_at_one_edit(seed):
    rng = random.Random(seed)
    make = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(6, 9)))
    words = sorted({make("abé"[: 2 + seed % 2]) for _ in range(rng.choice([1, 2, 30, 120]))})
    asked = words + [make("abéz") for _ in range(20)]
    size = np.array([len(w) for w in asked])
    index, none = BidirectionalIndex(words), np.zeros(len(asked), np.int64)
    (q1, w1), (q2, w2) = index.near(asked, size // 2, none), index.near(asked, none, size - size // 2)
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if one_edit(a, b)}
    assert {*zip(q1.tolist(), w1.tolist()), *zip(q2.tolist(), w2.tolist())} == want
    mixed = index.near(asked, np.full(len(asked), 2), np.full(len(asked), 1))
    assert set(zip(*(x.tolist() for x in mixed))) == {
        (i, j) for i, j in want
        if words[j].startswith(asked[i][:2]) and words[j].endswith(asked[i][-1]) and one_edit(asked[i][2:-1], words[j][2:-1])
    }


def test_query_equals_brute_force(small):
    want = brute_force(pairs(small))
    assert result(small) == want and len(want) > 500
    assert result(small, most=30) == want  # keys are cut on


def test_chains_ties_and_hot_halves(spark):
    rng = random.Random(4)
    texts = ["abcdefg " * 625, "abcdefh " * 125, "abcdeh " * 25, "abcdehh " * 5, "Zurück " * 6, "ZurÜck " * 40, "zuruck zurück " * 7, "tiefaa tiefab tiefac " * 30, "tiefad " * 5]
    texts += [" ".join(["aaaaaa" + "".join(rng.choice("xyz") for _ in range(5))] * rng.choice([5, 30])) for _ in range(400)]  # one prefix
    rows = [*enumerate(texts), (None, "abcdefg " * 9), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    want = brute_force(rows)
    assert result(docs) == want and result(docs, most=25) == want
    roots = {r[0]: r[2] for r in want}
    assert roots["abcdehh"] == "abcdefg" and roots["tiefad"] == "tiefaa"


def test_odd_and_empty(odd, empty):
    assert result(odd) == brute_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert result(empty) == []

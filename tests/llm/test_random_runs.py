import random
import string

import public_tokenizers

from lexmill.llm import secret_scan

ENC = secret_scan.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LETTERS = string.ascii_letters


def found(text):
    return [text[a:b] for a, k, b in secret_scan.find_spans(text, ENC) if secret_scan.KINDS[k] == "random"]


DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: alphabet, length, and the share of random strings that must be found: the recall of each class
CLASSES = [
    (LETTERS + DIGITS, 12, 0.9), (LETTERS, 12, 0.9), (LOWER + DIGITS, 12, 0.65), (LETTERS + DIGITS, 16, 0.95), (LETTERS, 16, 0.95), (LOWER + DIGITS, 16, 0.95),
    (UPPER, 16, 0.9), (LETTERS, 20, 0.95), (UPPER, 24, 0.95), (LOWER, 40, 0.95), (LETTERS + DIGITS + "+/", 20, 0.95), (LETTERS + DIGITS, 40, 0.95), (LOWER, 20, 0.9),
]


def test_recall_by_class():
    rng, got = random.Random(6), []
    for alphabet, n, least in CLASSES:
        runs = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400)]
        got.append((n, alphabet, sum(found(f"before {r} after") == [r] for r in runs) / len(runs), least))
    assert all(share >= least for *_, share, least in got), got
    # short strings in the shape of a word are mostly missed: a limit that finds them finds words
    lower = ["".join(rng.choice(LOWER) for _ in range(16)) for _ in range(400)]
    assert sum(found(r) == [r] for r in lower) / len(lower) >= 0.15


def test_false_hits_on_clean_texts(spark):
    """Runs of texts without planted secrets: none may be reported."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    hits = [(r["doc_id"], w) for r in docs for w in found(r["text"] or "")]
    assert hits == []


def test_words_times_and_short_letters_are_not():
    for s in ("internationalisation_of_words", "20240131T120000Z", "2024-01-31T12-00-00Z", "some-long-name/with/parts/99", "keitstlichschenverpf", "einpfauaueinchpf", "49529359002530529078"):
        assert found(s) == []


def test_a_run_beyond_a_pattern_is_reported_beside_it():
    run = "deadbeefdeadbeefK9Xq2Lw8Zr4Tm7"
    assert secret_scan.find_spans(run, ENC) == [(0, 2, 16), (0, 3, len(run))]
    assert found("password = k9Xq2Lw8Zr4Tm7Vb1Nc5") == []  # wholly inside the pattern's span

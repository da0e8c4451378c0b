"""Secret scan with a token-efficiency test.

Patterns find the plain kinds (assign, access, hex). Besides these, a run of key characters is tested by
its characters per token under a byte-pair vocabulary: text that the vocabulary has seen takes few tokens,
a random string takes many. Runs that are known digests (hexadecimal, of a digest's length) or identifiers
(UUIDs, times, numbers) are not tested; names and paths are tested word by word. The limit falls with the
evidence: 2.2 from 20 characters on; for 16 to 19, 2.2 with digits or inner capitals, 1.8 for capitals
alone and 1.5 for what is shaped like a word; for 12 to 15, 1.9 with digits or inner capitals.

Defined cases: a null text is empty; a run inside a pattern's span adds none, one that goes beyond it
is reported beside it; spans count code points, ends exclusive; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import table, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A text without these has no match of ASSIGN.
KEYWORDS = ("passw", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MIN_RUN = 12
#: Lengths in hexadecimal digits of the digests MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2}(-?[0-9]{2}){0,2}Z?")
#: Words of letters, or numbers, joined by marks: names, paths, dates, ranges.
NAME = re.compile(r"[=/+_-]*(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/+_=-]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*[=/+_-]*")
WORD, CAPITALS = re.compile("[A-Za-z]?[a-z]+"), re.compile("[A-Z]+")
#: At fewer characters per token a string of this shape and length or more is random; limits were set on
#: random strings and on the runs of a corpus, and tests report recall and false hits by class.
LIMITS = {"word": ((20, 2.2), (16, 1.5)), "capitals": ((20, 2.2), (16, 1.8)), "mixed": ((16, 2.2), (12, 1.9))}


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a rank file, once for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _is_known(run: str) -> bool:
    body = run.strip("=-_/+")
    if len(body) in DIGESTS and re.fullmatch(r"[0-9a-fA-F]+", body):
        return True
    return bool(UUID.fullmatch(body) or TIME.fullmatch(body))


def limit_of(word: str) -> float:
    """The limit for a string of key characters; 0 for one that is not tested."""
    if not re.search("[A-Za-z]", word):
        return 0.0
    shape = "word" if WORD.fullmatch(word) else "capitals" if CAPITALS.fullmatch(word) else "mixed"
    return next((limit for least, limit in LIMITS[shape] if len(word) >= least), 0.0)


def looks_random(run: str, enc) -> bool:
    if _is_known(run):
        return False
    tested = re.findall("[A-Za-z]+", run) if NAME.fullmatch(run) else [run]
    return any(limit and len(w) < limit * len(enc.encode_ordinary(w)) for w, limit in ((w, limit_of(w)) for w in tested))


def find_spans(text: str, enc) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), ordered."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    at, runs = 0, []
    for w in text.split():  # no run of HEX or RUN crosses white space
        if len(w) >= MIN_RUN:
            at = text.index(w, at)
            if len(w) >= MIN_HEX:
                out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(w) if m.end() - m.start() >= MIN_HEX]
            if not WORD.fullmatch(w) or len(w) >= MIN_HEX:
                runs += [(at + m.start(), at + m.end()) for m in RUN.finditer(w) if looks_random(m[0], enc)]
            at += len(w)
    if runs:
        base = list(out)
        out += [(a, 3, b) for a, b in runs if not any(s <= a and b <= e for s, _, e in base)]
    return sorted(out)


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>>, one row for each document."""
    d = texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(vocab_path)
        for b in batches:
            rows = [
                [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in find_spans(x, enc)]
                for x in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return d.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:bigint,kind:string,end:bigint>>")


def redact(docs: DataFrame, vocab_path: str) -> DataFrame:
    """The documents, all columns, with each union of spans replaced by [SECRET]; n_chars follows where it is present. A null text stays null."""
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text, enc):
        if text is None:
            return None
        parts, last = [], 0
        for s, _, e in find_spans(text, enc):
            if s > last or not parts and s == last:
                parts += [text[last:s], "[SECRET]"]
            last = max(last, e)
        return "".join(parts) + text[last:] if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(vocab_path)
        for b in batches:
            new = [clean(x, enc) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if size_at is not None:
                cols[size_at] = pa.array([None if x is None else len(x) for x in new], b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_secret_spans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = scan(table(spark, sf_dir, "documents"), path)
    # one pass over the spans of each document: counts, and the digests of base and of all spans
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(x["start"], KINDS.index(x["kind"]), x["end"]) for x in r] for r in b.column(1).to_pylist()]
            base = [[x for x in r if x[1] < 3] for r in rows]
            count = [pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(digest(r).encode()).hexdigest() for r in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *count, sha, pa.array([digest(r) for r in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    )

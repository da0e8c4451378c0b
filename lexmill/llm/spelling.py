"""Spelling variants of a corpus's vocabulary, grouped by one-edit searches in bidirectional FM-indexes.

1. Words are counted in each task and the counts summed, so a frequent word is a few rows.
2. A word at one edit from another shares its first or its last half. A word's two halves are keys
   under which it asks, and the halves that words of its length or one more or less would ask under are
   keys under which it is found. Keys are dealt to shards by their hash, so no shard sees the vocabulary.
3. A key that many words share is cut on: the part in which the edit lies is halved again, and the half
   without the edit joins the exact part. What is left to halve decides how many words a key can have, so
   this ends for every vocabulary and nothing is capped.
4. A shard builds one index over its words and runs all its searches (fm_index.py). A word that both
   searches could find is left to the one that matches the longer prefix, so each pair is found once.

Defined cases: a null text has no words; a null doc_id is written as the empty string; repeated rows
count each; equal counts are settled by code-point order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back, parts
from .fm_index import BidirectionalIndex
from .shared import materialize, table, texts

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
PLANTED = 199
KEY_ROWS = 50_000  # rows of a key from which it is cut on
SHARD_ROWS = 30_000
_HELD = 200_000  # words that a task counts before it hands them on
_ASKED = 2_000  # searches extended together
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)


def planted(base: int, run: str) -> str:
    """The run without one code point where its checksum behind `base` (that of the doc_id) says so."""
    h = zlib.crc32(run.encode(), base)
    at = h % len(run)
    return run if h % PLANTED else run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of MIN_LENGTH code points that occur MIN_COUNT times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for r, k in Counter(_RUN.findall(text.as_py().encode().lower().decode())).items():
                    held[planted(base, r)] += k
                if len(held) >= _HELD:
                    yield rows()
                    held.clear()
        yield rows()
        held.clear()
        give_back()

    counted = texts(docs).mapInArrow(run, "word string, n long").where(F.length("word") >= MIN_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit behind the middle of the open part, or before it. a, b: code points that the
    word shares at its start and end with a word of length `long` that asks; bar: a word that begins with
    so many of the asking word's is found elsewhere."""
    middle = F.col("a") + F.floor((F.col("long") - F.col("a") - F.col("b")) / 2).cast("int")
    behind = F.struct(middle.alias("a"), F.col("b"), F.col("bar"))
    before = F.struct(F.col("a"), (F.col("long") - middle).alias("b"), middle.alias("bar"))
    rows = rows.select("word", "n", "long", "ask", F.inline(F.array(behind, before)))
    ends = [F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise("")]
    return rows.withColumn("key", F.xxhash64(*ends))


def key_rows(words: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """word, n, ask, a, b, bar, key: under which keys each word asks and is found."""
    size = F.length("word")
    zero = F.lit(0)
    rows = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("long"), zero.alias("a"), zero.alias("b"), zero.alias("bar"))
    rows = _halved(rows.where(F.col("long") >= MIN_LENGTH).withColumn("ask", F.col("long") == size))
    settled = None
    while True:
        rows = materialize(rows, "keys")
        large = rows.where(F.col("long") - F.col("a") - F.col("b") > 1).groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > most)
        large = materialize(large.select("key"), "large-keys")
        if large.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        open_ = F.col("long") - F.col("a") - F.col("b") > 1
        small = rows.where(~open_).unionByName(rows.where(open_).join(large, "key", "left_anti").select(rows.columns))
        settled = small if settled is None else settled.unionByName(small)
        rows = _halved(rows.where(open_).join(large, "key", "left_semi"))


def near_words(words: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """word, n_near, best_n, best: how many words lie at one edit, and the most frequent of them."""
    rows = key_rows(words, most)
    shards = parts(rows.count(), min(SHARD_ROWS, most))
    rows = rows.select(F.pmod("key", F.lit(shards)).alias("shard"), "word", "n", "ask", "a", "b", "bar")

    def search(group: pa.Table) -> pa.Table:
        every, n = group.column("word").to_pylist(), group.column("n").to_numpy()
        held = sorted(set(every))
        place = {w: i for i, w in enumerate(held)}
        count = np.zeros(len(held), np.int64)
        count[[place[w] for w in every]] = n
        index = BidirectionalIndex(held)
        asks = np.flatnonzero(group.column("ask").to_numpy())
        a, b, bar = (group.column(c).to_numpy()[asks] for c in ("a", "b", "bar"))
        out = []
        for at in range(0, len(asks), _ASKED):
            asked = [every[i] for i in asks[at : at + _ASKED]]
            q, w = index.near(asked, a[at : at + _ASKED], b[at : at + _ASKED])
            mine = [not x or not held[j].startswith(asked[i][:x]) for i, j, x in zip(q.tolist(), w.tolist(), bar[at + q].tolist())]
            q, w = q[mine], w[mine]
            order = np.lexsort((w, -count[w], q))  # places are in code-point order
            first = np.flatnonzero(np.diff(q[order], prepend=-1))
            near = np.bincount(q, minlength=len(asked))
            out += [(asked[i], int(near[i]), int(count[j]), held[j]) for i, j in zip(q[order][first].tolist(), w[order][first].tolist())]
        give_back()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["word", "n_near", "best_n", "best"])

    found = rows.groupBy("shard").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each other; paths double each round, and a form is
    `RATIO` times as frequent as its word, so there are few."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    often = F.col("best_n") >= RATIO * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"),
    )
    near = materialize(near, "variants")
    rooted = near.join(_roots(near.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))

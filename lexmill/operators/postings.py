"""A stored inverted index, and ranking by it.

A row of the index is a document with its distinct tokens and their counts, its length and norm; the tokens' document
frequencies lie beside it in Parquet. Documents are counted where they are read, so neither the build nor a ranking
shuffles postings: each task of a ranking scores the documents of its rows for the questions' terms, which reach it as a
table of checked size, and keeps the best of them. More terms than that, or repeated ids, whose rows must
first be brought together, go by parts: documents are dealt into parts of a bounded number, and a
part scores its own documents for a block of questions. Pairs are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import scratch, settle
from . import in_place, ranking

DOCS_A_PART, QUESTIONS_A_BLOCK = 4_000, 256
TERMS_A_TASK = 200_000  # terms of questions that a task may hold; more go by parts
ROWS_AT_ONCE, _CELLS = 1_000, 2_000_000  # documents counted at once; pairs scored at once


@dataclass(frozen=True)
class Index:
    path: str
    parts: int
    docs: int
    mean_length: float
    #: whether a document is one row of `vectors`; else, and in indexes of other shape, `postings` is stored
    unique: bool = False

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if not self.unique or name not in ("postings", "lengths"):
            return spark.read.parquet(f"{self.path}/{name}")
        v = spark.read.parquet(f"{self.path}/vectors")
        if name == "lengths":
            return v.where("dl > 0").select("id", "dl", "norm")
        each = F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("tfs").alias("tf")))
        return v.select("part", "id", "dl", each)


_built: dict[tuple, Index] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """The files of a table with their sizes and times: an index of other files is stale."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time"), F.bit_xor(F.xxhash64("file_path"))).first())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, id, ts) the distinct tokens and their counts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            b = batch.slice(at, ROWS_AT_ONCE)
            ts = b.column(2)
            dl = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = ts.flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * size + words.indices.to_numpy(), return_counts=True)
            doc = key // size
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(dl))))), pa.int32())
            norm = np.sqrt(np.bincount(doc, tf.astype(float) ** 2, minlength=len(dl)))
            tokens = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(key % size)))
            cols = [b.column(0), b.column(1), pa.array(dl, pa.int32()), pa.array(norm), tokens, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "id", "dl", "norm", "tokens", "tfs"])


def build(docs: DataFrame, path: str) -> Index:
    """Writes the index of documents (id, body)."""
    spark = docs.sparkSession
    # one row for each id; only ids are shuffled
    n, ids = docs.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    parts = max(8, -(-n // DOCS_A_PART))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    split = docs.select(part.alias("part"), "id", text.tokens(F.col("body")).alias("ts"))
    unique = ids == n
    if unique:
        kind = docs.schema["id"].dataType.simpleString()
        split.mapInArrow(_counted, f"part int, id {kind}, dl int, norm double, tokens array<string>, tfs array<bigint>").write.parquet(f"{path}/vectors")
    else:
        each = split.select("part", "id", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
        each.groupBy("part", "id", "dl", "token").agg(F.count("*").alias("tf")).write.parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        lengths = postings.groupBy("id").agg(F.first("dl").alias("dl"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
        lengths.write.parquet(f"{path}/lengths")
    index = Index(path, parts, n, 0.0, unique)
    ranking.postings(index.read(spark, "postings")).write.parquet(f"{path}/tokens")
    total = index.read(spark, "lengths").agg(F.sum("dl")).first()[0] or 0
    return Index(path, parts, n, total / n if n else 0.0, unique)


def index_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Index:
    """The session's index of the documents table; built anew where the table's files are others."""
    return kept_index(spark, sf_dir, "documents", docs)


def kept_index(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame) -> Index:
    """The session's index of that name over documents (id, body) made from the documents table."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _built:
        _built[key] = build(docs, scratch(spark, "index"))
    return _built[key]


def said_by(index: Index, asked: DataFrame, terms: DataFrame, u) -> pa.Table | None:
    """qid, token, u of the questions' terms, where a task may hold them."""
    if not index.unique or asked.limit(TERMS_A_TASK + 1).count() > TERMS_A_TASK:
        return None
    return asked.join(terms, "t").select("qid", "token", u.cast("double").alias("u")).toArrow()


def _told(said: pa.Table, qids: np.ndarray) -> dict:
    """The questions' terms as a task takes them: `ask` and `u` lie by the places of the words, cut by `at`."""
    words = said.column("token").combine_chunks().dictionary_encode()
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    return {
        "qids": qids, "words": words.dictionary, "ask": np.searchsorted(qids, said.column("qid").to_numpy())[order], "u": said.column("u").to_numpy()[order],
        "at": np.searchsorted(words.indices.to_numpy()[order], np.arange(len(words.dictionary) + 1)),
    }


def _cells(told: dict, b: pa.RecordBatch, weigh: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Score and matched of the questions (rows) and a few documents (id, dl, norm, tokens, tfs)."""
    n = b.num_rows
    size = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), size)
    term = pc.fill_null(pc.index_in(b.column(3).flatten(), value_set=told["words"]), -1).to_numpy()
    hit = np.flatnonzero(term >= 0)
    doc, term = doc[hit], term[hit]
    w = weigh(b.column(4).flatten().to_numpy()[hit].astype(float), b.column(1).to_numpy()[doc].astype(float), b.column(2).to_numpy()[doc])
    turn = np.argsort(term, kind="stable")
    doc, term, w = doc[turn], term[turn], w[turn]
    total, matched = np.zeros((len(told["qids"]), n)), np.zeros((len(told["qids"]), n), np.int32)
    found, first = np.unique(term, return_index=True)
    for t, lo, hi in zip(found.tolist(), first.tolist(), np.append(first[1:], len(term)).tolist()):
        some = slice(told["at"][t], told["at"][t + 1])
        cells = told["ask"][some][:, None], doc[lo:hi]
        total[cells] += told["u"][some][:, None] * w[lo:hi]
        matched[cells] += 1
    return total, matched


def scored_in_place(rows: DataFrame, said: pa.Table, weigh: Callable, k: int | None, by: str) -> DataFrame:
    """As `_scored`, where the documents (id, dl, norm, tokens, tfs) are: weigh(tf, dl, norm) is a posting's share of the
    score. Each task keeps its k best of each question; without k, all pairs that share a term."""
    sent = rows.sparkSession.sparkContext.broadcast(_told(said, np.unique(said.column("qid").to_numpy())))

    def pairs(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """question (place), id, score, matched of a few documents."""
        total, matched = _cells(sent.value, b, weigh)
        i, j = np.nonzero(matched)
        return i, b.column(0).to_numpy()[j], total[i, j], matched[i, j].astype(np.int64)

    def best_of(i, ids, score, matched) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, -(np.round(score, 6) if by == "score" else matched), i))
        first = np.searchsorted(i[order], i[order])  # where the row's question begins
        keep = order[np.arange(len(order)) - first < k]
        return i[keep], ids[keep], score[keep], matched[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = sent.value["qids"]
        step, held, rows = max(1, _CELLS // max(1, len(qids))), [], 0

        def batch(i, ids, score, matched) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"qid": qids[i], "id": ids, "score": score, "matched": matched})

        for b in batches:
            for at in range(0, b.num_rows, step):
                found = pairs(b.slice(at, step))
                if k is None:
                    yield batch(*found)
                    continue
                held.append(best_of(*found))
                rows += len(held[-1][0])
                if rows > _CELLS:
                    held = [best_of(*map(np.concatenate, zip(*held)))]
                    rows = 0
        if held:
            yield batch(*best_of(*map(np.concatenate, zip(*held))))

    return rows.mapInArrow(run, "qid long, id long, score double, matched long")


def _rows(spark: SparkSession, index: Index) -> DataFrame:
    return index.read(spark, "vectors").select("id", "dl", "norm", "tokens", "tfs")


def _scored(index: Index, weighed: DataFrame, asked: DataFrame, k: int | None, by: str) -> DataFrame:
    """qid, id, score, matched. weighed: part, id, t, w; asked: qid, t, u. The k best of each part by score (sum
    of w * u) or matched; all pairs that share a term without k."""
    blocks = max(1, -(-asked.select("qid").distinct().count() // QUESTIONS_A_BLOCK))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    left = weighed.select("part", "id", "t", "w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("qid", F.col("t").alias("term"), "u", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))).alias("part"))

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, qids, total, matched = _matrix(rows, asks)
        if k is None:
            i, j = np.nonzero(matched)
            return pa.table({"qid": qids[i], "id": ids[j], "score": total[i, j], "matched": matched[i, j]})
        out = []
        for i in range(len(qids)):
            there = np.flatnonzero(matched[i])
            value = np.round(total[i, there], 6) if by == "score" else matched[i, there]
            there = there[np.lexsort((ids[there], -value))[:k]]
            out.append((np.full(len(there), qids[i]), ids[there], total[i, there], matched[i, there]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("qid", "id", "score", "matched"), cols)))

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(score, "qid long, id long, score double, matched long")


def _matrix(rows: pa.Table, asks: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, qids, and for each question and document the sum of w * u and the number of shared terms."""
    ids, doc = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    qids, ask = np.unique(asks.column("qid").to_numpy(), return_inverse=True)
    total, matched = np.zeros((len(qids), len(ids))), np.zeros((len(qids), len(ids)), np.int64)
    t, w, s, u = (x.to_numpy() for x in (rows.column("t"), rows.column("w"), asks.column("term"), asks.column("u")))
    by_row, by_ask = np.argsort(t, kind="stable"), np.argsort(s, kind="stable")
    t, s = t[by_row], s[by_ask]
    for token in np.intersect1d(t, s):
        a = by_row[slice(*np.searchsorted(t, [token, token + 1]))]
        b = by_ask[slice(*np.searchsorted(s, [token, token + 1]))]
        at = np.ix_(ask[b], doc[a])
        total[at] += u[b][:, None] * w[a]
        matched[at] += 1
    return ids, qids, total, matched


def lexical_share(bm25, matched, n):
    """Between 0 and 1: a capped share of the score, and how many of the question's n terms are matched."""
    return np.round(np.minimum(1.0, bm25 / np.maximum(2.0, 1.7 * n)) * 0.7 + 0.3 * matched / n, 9)


def grading(spark: SparkSession, index: Index, questions: DataFrame, ids: DataFrame) -> tuple[Callable, Callable]:
    """Orders by lexical share of questions (qid, asked: distinct terms) over the index's documents (ids).

    first(probes, k): qid, id, lex, probed of k best documents or more of each question, and again, probed, of the probes
    (qid, id) that share a term. place(probes): qid, id, place of probes (qid, id, lex); documents that share nothing
    stand behind all others, by id."""
    asked, terms = _numbered(spark, index, questions.select("qid", F.array_join("asked", " ").alias("body")))
    said = said_by(index, asked, terms, _idf(index))
    if said is not None:
        # no more questions than terms
        sizes = questions.select("qid", F.size("asked").cast("double").alias("n")).orderBy("qid").toArrow()
        told = _told(said, sizes.column("qid").to_numpy()) | {"n": sizes.column("n").to_numpy()[:, None]}
        return _graded_in_place(_rows(spark, index).where("id IS NOT NULL"), told, _bm25_part(index))
    weighed, asked = _bm25_weights(spark, index, asked, terms)
    weighed = settle(weighed, "weighed")
    asked = settle(asked.join(questions.select("qid", F.size("asked").alias("n")), "qid").select("qid", "t", "u", "n"), "asked")

    def place(probes: DataFrame) -> DataFrame:
        by_id = ranking.places(ids.select(F.lit(0).alias("k"), "id", (-F.col("id")).alias("by")), ["k"], "by", "id", 4096.0).select("id", F.col("rank").alias("by_id"))
        ahead = _graded(index, weighed, asked, probes, None).groupBy("qid", "id").agg(F.sum("ahead").alias("ahead"))
        rows = probes.join(ahead, ["qid", "id"], "left").join(by_id, "id")
        return rows.select("qid", "id", (F.coalesce("ahead", F.lit(0)) + F.when(F.col("lex") > 0, 1).otherwise(F.col("by_id"))).alias("place"))

    return lambda probes, k: _graded(index, weighed, asked, probes, k), place


def _graded_in_place(rows: DataFrame, told: dict, weigh: Callable) -> tuple[Callable, Callable]:
    """first and place of `grading` where the documents are: questions and probes reach the tasks, no posting is shuffled."""
    spark, step = rows.sparkSession, max(1, _CELLS // max(1, len(told["qids"])))
    sent = spark.sparkContext.broadcast(told)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                some = b.slice(at, step)
                total, matched = _cells(sent.value, some, weigh)
                yield some.column(0).to_numpy(), lexical_share(total, matched, sent.value["n"]), matched > 0

    def first(probes: DataFrame, k: int) -> DataFrame:
        def one(turn: int, asked: tuple[np.ndarray, ...]) -> DataFrame:
            probed = spark.sparkContext.broadcast(asked[:2])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                (i, wanted), qids = probed.value, sent.value["qids"]
                best = in_place.Best(len(qids), k)
                for ids, lex, there in shares(batches):
                    p, j = in_place.held(ids, wanted)
                    shared = there[i[p], j]
                    p, j = p[shared], j[shared]
                    yield in_place.table(qids, i[p], ids[j], lex=lex[i[p], j], probed=np.ones(len(p), bool))
                    if turn == 0:
                        best.add(ids, lex, there)
                yield in_place.table(qids, best.i, best.ids, lex=best.value, probed=np.zeros(len(best.i), bool))

            return rows.mapInArrow(run, "qid long, id long, lex double, probed boolean")

        return reduce(DataFrame.unionByName, [one(n, a) for n, a in enumerate(in_place.turns(probes, told["qids"]))])

    def place(probes: DataFrame) -> DataFrame:
        def one(asked: tuple[np.ndarray, ...]) -> DataFrame:
            probed = spark.sparkContext.broadcast(asked)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                i, wanted, lex_of = probed.value
                some, none = np.flatnonzero(lex_of > 0), np.flatnonzero(lex_of <= 0)
                ahead = np.zeros(len(i), np.int64)
                for ids, lex, there in shares(batches):
                    ahead[some] += in_place.ahead(ids, lex, there, (i[some], wanted[some], lex_of[some]))
                    # before one that shares nothing stand all that share a term, and the others of smaller ids
                    ahead[none] += np.count_nonzero(there, axis=1)[i[none]]
                    ahead[none] += in_place.ahead(ids, np.zeros(lex.shape), ~there, (i[none], wanted[none], lex_of[none]))
                yield in_place.table(sent.value["qids"], i, wanted, ahead=ahead)

            return rows.mapInArrow(run, "qid long, id long, ahead long")

        counts = reduce(DataFrame.unionByName, map(one, in_place.turns(probes, told["qids"], "lex")))
        return counts.groupBy("qid", "id").agg((F.sum("ahead") + 1).alias("place"))

    return first, place


def _graded(index: Index, weighed: DataFrame, asked: DataFrame, probes: DataFrame, k: int | None) -> DataFrame:
    """Two uses of a part's scores by lexical share, for asked (qid, t, u, n: terms of the question).

    With k: qid, id, lex, probed of each part's k best, and of the probes (qid, id), which go to their own part.
    Without: qid, id, ahead for probes (qid, id, lex), which go to all parts: how many documents of the part
    stand before it; for a probe that shares nothing, how many sharing ones have a larger id."""
    blocks = max(1, -(-asked.select("qid").distinct().count() // QUESTIONS_A_BLOCK))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    left = weighed.select("part", "id", "t", "w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))).alias("to_part")
    no = lambda kind: F.lit(None).cast(kind)
    terms = asked.select("qid", F.col("t").alias("term"), "u", F.col("n").cast("double").alias("n"), no("bigint").alias("id"), no("double").alias("lex"), block.alias("to_block"), every)
    own = F.pmod(F.xxhash64("id"), F.lit(index.parts)).cast("int").alias("to_part")
    lex = no("double").alias("lex") if k else F.col("lex")
    named = probes.select("qid", no("bigint").alias("term"), no("double").alias("u"), no("double").alias("n"), "id", lex, block.alias("to_block"), own if k else every)

    def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
        is_probe = pc.is_valid(asks.column("id"))
        probe, asks = asks.filter(is_probe), asks.filter(pc.invert(is_probe))
        ids, qids, total, matched = _matrix(rows, asks)
        n = dict(zip(asks.column("qid").to_pylist(), asks.column("n").to_pylist()))
        of = {}
        for q, i, v in zip(probe.column("qid").to_pylist(), probe.column("id").to_pylist(), probe.column("lex").to_pylist()):
            of.setdefault(q, []).append((i, v))
        out = []
        for j, q in enumerate(qids.tolist()):
            there = np.flatnonzero(matched[j])
            value, mine = lexical_share(total[j, there], matched[j, there], n[q]), ids[there]
            if k:
                first = np.lexsort((mine, -value))[:k]
                asked_too = np.flatnonzero(np.isin(mine, [i for i, _ in of.get(q, ())]))
                chosen = np.concatenate((first, asked_too))
                out.append((np.full(len(chosen), q), mine[chosen], value[chosen], np.arange(len(chosen)) >= len(first)))
            elif q in of:
                i, v = np.array([x for x, _ in of[q]], np.int64), np.array([x for _, x in of[q]])
                order = np.lexsort((mine, -value))
                # places in the part by value, then id; equal values are told apart by their ids
                lo, hi = (np.searchsorted(-value[order], -v, side=s) for s in ("left", "right"))
                ahead = lo + np.array([np.searchsorted(mine[order][a:b], x) for a, b, x in zip(lo, hi, i)], np.int64)
                larger = len(mine) - np.searchsorted(np.sort(mine), i, side="right")
                out.append((np.full(len(i), q), i, np.where(v > 0, ahead, larger)))
        kinds = (np.int64, np.int64, np.float64, bool) if k else (np.int64, np.int64, np.int64)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in kinds]
        return pa.table(dict(zip(("qid", "id", "lex", "probed") if k else ("qid", "id", "ahead"), cols)))

    out = f"qid long, id long, {'lex double, probed boolean' if k else 'ahead long'}"
    return left.groupBy("block", "part").cogroup(terms.unionByName(named).groupBy("to_block", "to_part")).applyInArrow(score, out)


def best(index: Index, weighed: DataFrame, asked: DataFrame, k: int, by: str) -> DataFrame:
    return first_of(_scored(index, weighed, asked, k, by), k, by)


def first_of(scored: DataFrame, k: int, by: str) -> DataFrame:
    return ranking.top(scored.withColumn("_by", F.round("score", 6) if by == "score" else F.col(by)), "_by", k).drop("_by")


def settle_terms(terms: DataFrame) -> DataFrame:
    """The terms with a number t each, written so that the number stays."""
    return settle(terms.withColumn("t", F.monotonically_increasing_id()), "terms")


def _numbered(spark: SparkSession, index: Index, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (qid, t, q), and terms (token, t, df, cf, max_tf) of the questions' tokens that the index has."""
    each = questions.select("qid", F.explode(text.tokens(F.col("body"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("q"))
    terms = index.read(spark, "tokens").join(each.select("token").distinct(), "token")
    terms = settle_terms(terms)
    return each.join(terms.select("token", "t"), "token").select("qid", "t", "q"), terms


def _idf(index: Index):
    return F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _bm25_part(index: Index) -> Callable:
    k1, b, mean = ranking.K1, ranking.B, index.mean_length
    return lambda tf, dl, norm: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def _bm25_weights(spark: SparkSession, index: Index, asked: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = _bm25_part(index)(F.col("tf"), F.col("dl"), None)
    weighed = index.read(spark, "postings").join(terms, "token").select("part", "id", "t", (_idf(index) * part).alias("w"))
    return weighed, asked.withColumn("u", F.lit(1.0))


def _bm25(spark: SparkSession, index: Index, questions: DataFrame, k: int | None, by: str) -> DataFrame:
    asked, terms = _numbered(spark, index, questions)
    said = said_by(index, asked, terms, _idf(index))
    if said is not None:
        return scored_in_place(_rows(spark, index), said, _bm25_part(index), k, by)
    return _scored(index, *_bm25_weights(spark, index, asked, terms), k, by)


def bm25_top(spark: SparkSession, index: Index, questions: DataFrame, k: int, by: str = "score") -> DataFrame:
    """qid, id, bm25, matched, rank of questions (qid, body); by score or by the number of matched terms."""
    return first_of(_bm25(spark, index, questions, k, by), k, by).withColumnRenamed("score", "bm25")


def bm25_all(spark: SparkSession, index: Index, questions: DataFrame) -> DataFrame:
    """qid, id, bm25, matched of every pair that shares a term: for orders that need complete lists."""
    return _bm25(spark, index, questions, None, "score").withColumnRenamed("score", "bm25")


def cosine_top(spark: SparkSession, index: Index, questions: DataFrame, k: int, logarithmic: bool = False) -> DataFrame:
    """qid, id, score (cosine of term frequencies), rank. Logarithmic: a document's count weighs 1 + ln(1 + tf)
    over the plain norm, in per cent."""
    asked, terms = _numbered(spark, index, questions)
    each = questions.select("qid", F.explode(text.tokens(F.col("body"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("q"))
    norms = each.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    asked = asked.join(norms, "qid").select("qid", "t", (F.col("q") / F.col("qn")).alias("u"))
    said = said_by(index, asked, terms, F.col("u"))
    if said is not None:
        count = (lambda tf: 100 * (1 + np.log1p(tf))) if logarithmic else (lambda tf: tf)
        return first_of(scored_in_place(_rows(spark, index), said, lambda tf, dl, norm: count(tf) / norm, k, "score"), k, "score")
    weight = 100 * (1 + F.log1p("tf")) if logarithmic else F.col("tf")
    weighed = index.read(spark, "postings").join(terms.select("token", "t"), "token").join(index.read(spark, "lengths").select("id", "norm"), "id")
    return best(index, weighed.select("part", "id", "t", (weight / F.col("norm")).alias("w")), asked, k, "score")

"""Incremental and reversible removal of lines that several documents hold.

A line's key is the line without white space at its ends, A-Z in lower case; keys of LEAST_CHARS code
points or more are held by a 128-bit hash. An index is a folder of Parquet tables that grow by versions:

  lines    hi, lo, doc_id: which document holds which key
  gone     doc_id: documents that were taken out
  counts   shard, hi, lo, refs, largest: documents that hold a key, and the largest of them
  filters  shard, body: a cuckoo filter over the shard's keys with LEAST_DOCS references or more
  commits  a row for each version, written last: what a lost run has left is ignored and overwritten

`insert` and `delete` write only the keys and the shards that they touch. The exact counts say which keys
reach or leave LEAST_DOCS; those are added to and taken from the filters. A shard whose filter has no room
is built anew from its counts. `dedup` asks the filters first, so of most lines nothing is shuffled, and
settles what passes by a join with the exact counts, so a false hit of a filter changes nothing. Filters
up to FILTER_BYTES go to all tasks; above that, distinct keys meet their shard's filter in a cogroup.

A key in a third of all documents is counted in parts before it meets, and is a single row of `counts`.

Defined cases: a null or empty text is one empty line; a null doc_id cannot be taken out again, so its
lines are neither counted nor dropped; rows of one doc_id are one document, which loses the same lines in
all of them; inserting a document again adds nothing; an empty table gives an empty result; `dedup` keeps
all columns whatever their names, n_chars follows the text, and a null text stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import give_back, parts
from .cuckoo import LOAD, SLOTS, Cuckoo, Filters
from .shared import fresh_dir, materialize, table

LEAST_CHARS, LEAST_DOCS = 20, 3
TEXT_A_SHARD = 16 << 20
FILTER_BYTES = 64 << 20
KEY = ["hi", "lo"]
COUNTS = "shard bigint, hi bigint, lo bigint, refs bigint, largest bigint"


def line_key(line: bytes) -> bytes:
    """The 16 bytes of a line's key; none where it is too short."""
    k = line.strip().lower()  # for bytes: \x20 and \x09 to \x0D, and A to Z
    if len(k) < LEAST_CHARS or len(k) < 4 * LEAST_CHARS and len(k.decode()) < LEAST_CHARS:
        return b""
    return xxhash.xxh3_128_digest(k)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def doc_keys(docs: DataFrame, filters=None) -> DataFrame:
    """hi, lo, doc_id of the keys of each row, each once; of those in the filters (a broadcast) if given."""
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [{line_key(x) for x in t.as_py().encode().split(b"\n")} - {b""} for t in b.column(1)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            hi, lo = _halves([k for keys in each for k in keys])
            ids = np.repeat(b.column(0).to_numpy(), sizes)
            if filters is not None:
                some = filters.value.contain(hi, lo)
                hi, lo, ids = hi[some], lo[some], ids[some]
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(ids)], names=["hi", "lo", "doc_id"])
        give_back()

    return d.mapInArrow(run, "hi bigint, lo bigint, doc_id bigint")


def _cut(rows: DataFrame, digest: bool) -> DataFrame:
    """rows (text, keys: the keys that go, null for none, and others) with text cut, n_lines, n_dropped; with
    `digest` the text is the SHA-256 of it."""
    at = {c: i for i, c in enumerate(rows.columns)}
    others = [f for f in rows.schema.fields if f.name not in ("text", "keys")]
    kinds = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, keys in zip(b.column(at["text"]), b.column(at["keys"]).to_pylist()):
                null, raw = not t.is_valid, (t.as_py() or "").encode()
                n = raw.count(b"\n") + 1
                kept = raw
                if keys:
                    gone = {np.array([k["hi"], k["lo"]], "<i8").tobytes() for k in keys}
                    lines = [x for x in raw.split(b"\n") if line_key(x) not in gone]
                    kept = b"\n".join(lines)
                dropped = n - len(lines) if keys else 0
                out.append((hashlib.sha256(kept).hexdigest() if digest else None if null else kept.decode(), n, dropped))
            text, n, dropped = zip(*out) if out else ((), (), ())
            new = [pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(at[f.name]) for f in others), *new], names=[f.name for f in kinds])

    return rows.mapInArrow(run, kinds)


class LineIndex:
    """Reference counts and filters in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        first = spark.read.parquet(f"{path}/commits").agg(F.max("version"), F.max("shards")).first()
        self.version, self.shards = first

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int) -> LineIndex:
        none = spark.createDataFrame
        for name, kind in (("lines", "hi bigint, lo bigint, doc_id bigint"), ("gone", "doc_id bigint"), ("counts", COUNTS), ("filters", "shard bigint, body binary")):
            none([], kind).write.mode("overwrite").parquet(f"{path}/{name}/v=0")
        none([(0, shards)], "version long, shards long").coalesce(1).write.mode("append").parquet(f"{path}/commits")
        return cls(spark, path)

    def _read(self, name: str) -> DataFrame:
        kinds = {"lines": "hi bigint, lo bigint, doc_id bigint", "gone": "doc_id bigint", "counts": COUNTS, "filters": "shard bigint, body binary"}
        return self.spark.read.schema(f"{kinds[name]}, v int").parquet(f"{self.path}/{name}").where(F.col("v") <= self.version)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}/v={self.version + 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self) -> None:
        row = [(self.version + 1, self.shards)]
        self.spark.createDataFrame(row, "version long, shards long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.version += 1

    def lines(self) -> DataFrame:
        """hi, lo, doc_id of the documents that the index holds."""
        gone = self._read("gone").groupBy("doc_id").agg(F.max("v").alias("until"))
        held = self._read("lines").alias("l")
        if self.version > 1:
            held = held.join(gone.alias("g"), (F.col("l.doc_id") == F.col("g.doc_id")) & (F.col("until") > F.col("v")), "left_anti")
        return held.select("hi", "lo", "doc_id")

    def counts(self) -> DataFrame:
        """shard, hi, lo, refs, largest: the latest of each key."""
        if self.version <= 1:
            return self._read("counts").drop("v")
        last = self._read("counts").groupBy("shard", *KEY).agg(F.max(F.struct("v", "refs", "largest")).alias("last"))
        return last.select("shard", *KEY, "last.refs", "last.largest")

    def filters(self) -> DataFrame:
        """shard, body (null: built anew by the next version, until then any key may be in it)."""
        last = self._read("filters").groupBy("shard").agg(F.max(F.struct("v", "body")).alias("last"))
        return last.select("shard", "last.body")

    def _turn(self, counts: DataFrame) -> None:
        """Writes the new counts (shard, hi, lo, refs, largest, was: references before) of the touched keys and
        the filters of the shards in which a key reached or left LEAST_DOCS, then commits."""
        many, before = F.col("refs") >= LEAST_DOCS, F.col("was") >= LEAST_DOCS
        changed = materialize(counts.where(many != before).select("shard", *KEY, many.alias("up")), "turned-keys")
        old = self.filters()
        # shards whose filter has no room for what they will hold
        held = self.counts_with(counts).where(F.col("refs") >= LEAST_DOCS).join(changed.select("shard").distinct(), "shard", "left_semi")
        room = F.coalesce(F.length("body"), F.lit(0)) / (2 * SLOTS) * SLOTS * LOAD
        sizes = held.groupBy("shard").agg(F.count("*").alias("keys")).join(old, "shard", "left")
        anew = materialize(sizes.where(F.col("keys") > room).select("shard"), "new-filters")

        def build(group: pa.Table) -> pa.Table:
            made = Cuckoo.of(group.column("lo").to_numpy())
            return pa.table({"shard": group.column("shard")[:1], "body": pa.array([made.cells.tobytes()], pa.binary())})

        def patch(filters: pa.Table, keys: pa.Table) -> pa.Table:
            up, lo = keys.column("up").to_numpy(), keys.column("lo").to_numpy()
            body = filters.column("body")[0].as_py() if filters.num_rows else None
            if body is not None:
                made = Cuckoo(len(body) // (2 * SLOTS), body)
                made.remove(lo[~up])
                made.insert(lo[up])
                body = None if made.full else made.cells.tobytes()
            return pa.table({"shard": keys.column("shard")[:1], "body": pa.array([body], pa.binary())})

        kind = "shard bigint, body binary"
        built = held.join(anew, "shard", "left_semi").select("shard", "lo").groupBy("shard").applyInArrow(build, kind)
        rest = changed.join(anew, "shard", "left_anti")
        touched = old.join(rest.select("shard").distinct(), "shard", "left_semi")
        patched = touched.groupBy("shard").cogroup(rest.groupBy("shard")).applyInArrow(patch, kind)
        self._write(built.unionByName(patched), "filters")
        self._commit()

    def counts_with(self, counts: DataFrame) -> DataFrame:
        """The counts as they will be: the touched keys' new ones and the others' old ones."""
        new = counts.select("shard", *KEY, "refs", "largest")
        return new if self.version == 0 else self.counts().join(new.select(*KEY), KEY, "left_anti").unionByName(new)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; keys that the index holds of the same document are not counted again."""
        new = doc_keys(docs).distinct()
        if self.version:
            new = new.join(self.lines(), [*KEY, "doc_id"], "left_anti")
        new = self._write(new, "lines")
        self._write(self.spark.createDataFrame([], "doc_id bigint"), "gone")
        delta = new.groupBy(*KEY).agg(F.count("*").alias("more"), F.max("doc_id").alias("top"))
        delta = delta.withColumn("shard", F.pmod("hi", F.lit(self.shards)))
        if self.version:
            delta = delta.join(self.counts().drop("shard"), KEY, "left")
        else:
            delta = delta.withColumn("refs", F.lit(0).cast("long")).withColumn("largest", F.lit(None).cast("long"))
        was = F.coalesce("refs", F.lit(0))
        counts = delta.select(
            "shard", *KEY, (was + F.col("more")).alias("refs"),
            F.greatest("top", F.when(was > 0, F.col("largest"))).alias("largest"), was.alias("was"),
        )
        return self._turned(counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out; their keys are counted anew from the lines that stay."""
        ids = doc_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        lines = self.lines()
        keys = materialize(lines.join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "touched-keys")
        self._write(self.spark.createDataFrame([], "hi bigint, lo bigint, doc_id bigint"), "lines")
        ids = self._write(ids, "gone")
        stay = lines.join(keys, KEY, "left_semi").join(ids, "doc_id", "left_anti")
        left = stay.groupBy(*KEY).agg(F.count("*").alias("left"), F.max("doc_id").alias("top"))
        counts = self.counts().join(keys, KEY, "left_semi").withColumnRenamed("refs", "was").drop("largest").join(left, KEY, "left")
        return self._turned(counts.select("shard", *KEY, F.coalesce("left", F.lit(0)).cast("long").alias("refs"), F.col("top").alias("largest"), "was"))

    def _turned(self, counts: DataFrame) -> LineIndex:
        held = materialize(counts, "new-counts") if self.version else None
        # of a first version all counts are new: they are written once and serve as their own change
        written = self._write((held if held is not None else counts).drop("was"), "counts")
        self._turn(held if held is not None else written.withColumn("was", F.lit(0).cast("long")))
        return self

    def dropped(self, docs: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
        """doc_id, keys (the keys whose lines it loses)."""
        exact = self.counts().where(F.col("refs") >= LEAST_DOCS).select(*KEY, "largest")
        filters = self.filters()
        size = filters.agg(F.sum(F.length("body"))).first()[0] or 0
        if size <= most and self.shards <= most:
            rows = [(r["shard"], None if r["body"] is None else bytes(r["body"])) for r in filters.collect()]
            found = doc_keys(docs, self.spark.sparkContext.broadcast(Filters(self.shards, rows)))
        else:
            found = self._routed(doc_keys(docs), filters)
        gone = found.join(exact, KEY).where("doc_id <> largest").groupBy("doc_id")
        return gone.agg(F.collect_set(F.struct(*KEY)).alias("keys"))

    def _routed(self, found: DataFrame, filters: DataFrame) -> DataFrame:
        """Of hi, lo, doc_id the rows whose key passes its shard's filter."""
        found = materialize(found, "line-keys")
        asked = found.select(*KEY).distinct().withColumn("shard", F.pmod("hi", F.lit(self.shards)))

        def ask(keys: pa.Table, body: pa.Table) -> pa.Table:
            own = Filters(1, [(0, b) for b in body.column("body").to_pylist()])
            return keys.select(KEY).filter(pa.array(own.contain(keys.column("hi").to_numpy(), keys.column("lo").to_numpy())))

        passed = asked.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, "hi bigint, lo bigint")
        return found.join(passed, KEY, "left_semi")

    def _joined(self, rows: DataFrame, docs: DataFrame, most: int) -> DataFrame:
        gone = self.dropped(docs, most)
        none = F.lit(None).cast(gone.schema["keys"].dataType)
        known = rows.where("id is not null").join(gone.withColumnRenamed("doc_id", "id"), "id", "left")
        return known.unionByName(rows.where("id is null").withColumn("keys", none)).drop("id")

    def measure(self, docs: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), "doc_id", "text")
        cut = _cut(self._joined(rows, docs, most), True)
        return cut.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"))

    def dedup(self, docs: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
        """The rows, all columns, without those lines."""
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*docs.columns).alias("row"))
        cut = _cut(self._joined(rows, docs, most), False)
        new = {"text": F.col("text"), "n_chars": F.length("text")}
        kinds = {f.name: f.dataType for f in docs.schema}
        return cut.select(*[(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def build(docs: DataFrame, path: str | None = None) -> LineIndex:
    """A new index over the documents."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return LineIndex.create(spark, path or fresh_dir(spark, "line-index"), parts(size, TEXT_A_SHARD)).insert(docs)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return build(docs).measure(docs)


ORACLE = r"""WITH l AS (SELECT doc_id, i, x, translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT k, count(DISTINCT doc_id) AS refs, max(doc_id) AS largest FROM l WHERE length(k) >= 20 GROUP BY k),
m AS (SELECT l.*, coalesce(refs >= 3 AND l.doc_id <> largest, FALSE) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

"""Near-duplicate groups by SimHash and multi-index hashing.

Each distinct fingerprint stands once in a table for each of its segments, keyed by the segment's
bits. It probes each table with every key of a small Hamming ball around its own segment: where two
fingerprints differ in at most r bits, one of m segments differs in at most r // m bits, so no link
is missed. The complete distance is verified inside the join. Links lead to connected components by
alternating large-star and small-star steps.

Copies of a text share a fingerprint and are one node; the work follows the number of distinct
fingerprints. With two 32-bit segments a ball has 33 keys, so each fingerprint sends 66 probes.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text with
fewer words than a shingle has one shingle of all its words; repeated rows each get a row; a null
doc_id is kept and takes the component of its fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import parts
from .shared import materialize, table, texts

BITS = 64
NODES_A_TASK = 10_000
_BLOCK = 1 << 18  # shingles whose bits are unpacked at once


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit j is set if it is set in over half of the shingles' XXH64 values."""
    w = text.encode().lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h64(b" ".join(w), seed)
    each = [h64(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)))]
    return majority(np.array(each, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """Bit j is set if it is set in over half of the values."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    d = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, words, seed) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _key(segment: int, bits):
    return F.struct(F.lit(segment).alias("seg"), bits.alias("key"))


def links(nodes: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """a < b: all pairs of distinct fingerprints (column fp, unique) at max_bits or fewer."""
    radius, width = max_bits // segments, -(-BITS // segments)
    if radius > 1:
        raise ValueError("take more segments: balls of radius 0 or 1 are built")
    keys, probes = [], []
    for s in range(segments):
        bits = min(width, BITS - s * width)
        own = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << bits) - 1))
        flips = [0] + ([1 << b for b in range(bits)] if radius else [])
        keys.append(_key(s, own))
        probes += [_key(s, own.bitwiseXOR(F.lit(f).cast("long"))) for f in flips]
    nodes = nodes.repartition(parts(nodes.count(), NODES_A_TASK), "fp")  # a node has few bytes but many probes
    stored = nodes.select(F.col("fp").alias("b"), F.inline(F.array(*keys)))
    asked = nodes.select(F.col("fp").alias("a"), F.inline(F.array(*probes)))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    hit = asked.alias("p").join(
        stored.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & near
    )
    return hit.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for all nodes of the edges (u, v); both ends any order.

    Alternates large-star and small-star until the edges are stars; each round is written to the
    shared folder. Minima are aggregated before they are joined back, so a hot node costs no group.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        centre = e.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        n, ends = e.agg(F.count("*"), F.countDistinct("u")).first()
        if n == ends and centre.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, segments: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of max_bits or fewer)."""
    each = materialize(fingerprints(docs, words, seed), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp"), max_bits, segments).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return each.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """The documents without all but the smallest doc_id of each group; rows of a null doc_id stay."""
    drop = near_duplicates(docs, words, max_bits, segments).where("doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti")


def op10_simhash_groups(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near copies at a true similarity of their shingles, for the pipeline.

Candidates come from operator 10's search first: the SimHash of a text's distinct shingles of five words, 64
bits, and the fingerprints at MAX_BITS or fewer, found by Hamming balls in two segments; those that such links
join are one bucket. Two SimHashes at a similarity of 0.8 lie about 10 bits apart, so this finds the closest
copies, and balls that reach 10 bits would meet by chance. The others come from BANDS further segments, each
the 64-bit hash of the smallest values of ROWS hash functions over the same shingles, with SKETCH bits beside
them: the lowest bit of each smallest value. Texts of Jaccard similarity s share such a segment with probability
1 - (1 - s ** ROWS) ** BANDS, 0.989 at 0.8, and each bit of the sketches differs with probability (1 - s) / 2.

Multi-index hashing over these fingerprints: texts that share a bucket or a segment are fetched by a join on it,
whose condition verifies the complete distance of the sketches (MOST_BITS, which a pair of similarity
0.8 exceeds once in 1,200) and the numbers of shingles; a pair is taken from the first segment that it
shares. What is left is linked where the Jaccard similarity of the shingles themselves reaches the limit. Members
of a bucket first meet its centre, the member with most neighbours: each one of its centres, then, after
the components of these links, the centres outside its component; at last those outside the centre's
component meet the bucket's other components. A large group of copies costs one comparison of shingles
for each member, and no candidate between different components is left out.

Defined cases: a null text is empty; wordless texts are copies of each other; a text with fewer words
than a shingle has one shingle of all its words; of each group one row stays: the smallest doc_id, null
ids last, then the smallest hash of the row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back, pack_sorted, parts, unpack_sorted
from .shared import materialize
from .simhash_mih import components, majority
from .simhash_mih import links as within

WORDS, SIMILAR, MAX_BITS = 5, 0.8, 3
BANDS, ROWS = 40, 10
SKETCH, MOST_BITS = 384, 57
SHINGLES_A_SHARD = 1_500_000
_MEMO = 60_000  # words whose hashes a worker keeps
_BLOCK = 1 << 10  # shingles hashed at once
_RNG = np.random.default_rng(42)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_memo: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    h = _memo.get(w)
    if h is None:
        if len(_memo) >= _MEMO:
            _memo.clear()
        h = _memo[w] = xxhash.xxh64_intdigest(w, 42)
    return h


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; at least one."""
    w = text.encode().lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    h = np.fromiter(map(_word, w), np.uint64, len(w))
    n = len(h) - words + 1
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s += h[k : k + n] * _PLACE[k]
    s ^= s >> np.uint64(31)
    s *= _PLACE[-1]
    return np.unique(s ^ (s >> np.uint64(29)))


def smallest(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _BLOCK):
        np.minimum(low, (np.multiply.outer(_TIMES, s[at : at + _BLOCK]) + _PLUS[:, None]).min(axis=1), out=low)
    return low


def segments(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def sketch(low: np.ndarray) -> np.ndarray:
    """A bit of each of the first SKETCH smallest values, as 64-bit integers."""
    mixed = low[:SKETCH] * _PLACE[-2]
    return np.packbits((mixed >> np.uint64(40)).astype(np.uint8) & 1).view("<u8")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _node():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, node, row (a hash of the whole row), n (shingles), fp (the SimHash), keys (the segments), sketch."""
    d = docs.select("doc_id", _node().alias("node"), F.xxhash64(*_columns(docs)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[int, tuple] = {}
            for node, x in zip(b.column(1).to_pylist(), b.column(3)):
                if node not in known:
                    s = shingles(x.as_py())
                    low = smallest(s)
                    known[node] = len(s), majority(s), segments(low).view(np.int64), sketch(low).view(np.int64)
            give_back()
            n, fps, keys, bits = zip(*(known[i] for i in b.column(1).to_pylist())) if b.num_rows else ((), (), (), ())
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int64()), fp, pa.array(keys, longs), pa.array(bits, longs)], names=["doc_id", "node", "row", "n", "fp", "keys", "sketch"]
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, node bigint, row bigint, n bigint, fp bigint, keys array<bigint>, sketch array<bigint>")


def balls(each: DataFrame) -> DataFrame:
    """fp, ball: the smallest SimHash reachable over links of MAX_BITS or fewer, for those that have a link."""
    fps = materialize(each.select("fp").distinct(), "fingerprints")
    found = components(within(fps, MAX_BITS).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("node").alias("fp"), F.col("root").alias("ball"))


def _near(a: str, b: str, similar: float):
    """The condition on sketches and numbers of shingles of the aliases a and b."""
    bits = [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH // 64)]
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) >= similar * F.greatest(n, m)) & (sum(bits[1:], bits[0]) <= MOST_BITS)


def _first_shared(a: str, b: str):
    """No segment before the band at hand is shared."""
    before = [F.slice(f"{x}.keys", F.lit(1), F.col(f"{a}.band")) for x in (a, b)]
    return ~F.exists(F.zip_with(*before, lambda x, y: x == y), lambda same: same)


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """The distinct nodes of pairs, as node, with further columns."""
    return pairs.select("node", *more).distinct().unionByName(pairs.select(F.col("hub").alias("node"), *more).distinct()).distinct()


def _bodies(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, s: the shingles of the nodes, cut once for each and packed; written to the shared folder."""
    held = docs.select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text")).join(nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for at in range(0, b.num_rows, 200):
                part = [(i, shingles(x.as_py())) for i, x in zip(b.column(0)[at : at + 200].to_pylist(), b.column(1)[at : at + 200]) if i not in seen and not seen.add(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([pack_sorted(s) for _, s in part], pa.binary())], names=["node", "s"])
        give_back()

    return materialize(held.mapInArrow(run, "node bigint, s binary").groupBy("node").agg(F.first("s").alias("s")), "shingles")


def _verified(pairs: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """The pairs (node, hub, n: shingles of the node) whose shingles are similar enough, as a, b. Pairs are dealt
    by their node; a shard holds the shingles of each of its nodes once, and of each hub that they ask for."""
    total = pairs.select("node", "n").distinct().agg(F.sum("n")).first()[0] or 0
    shards = parts(total, SHINGLES_A_SHARD)
    pairs = pairs.select(F.pmod("node", F.lit(shards)).alias("shard"), "node", "hub")

    def compare(some: pa.Table, asks: pa.Table) -> pa.Table:
        s = dict(zip(some.column("node").to_pylist(), map(unpack_sorted, some.column("s").to_pylist())))
        out = []
        for node, hub in zip(asks.column("member").to_pylist(), asks.column("with").to_pylist()):
            few, many = sorted((s[node], s[hub]), key=len)
            both = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
            if both >= similar * (len(few) + len(many) - both):
                out.append((min(node, hub), max(node, hub)))
        s.clear()
        give_back()
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    held = _ends(pairs, "shard").join(bodies, "node").groupBy("shard")
    asks = pairs.select(F.col("shard").alias("part"), F.col("node").alias("member"), F.col("hub").alias("with"))
    links = held.cogroup(asks.groupBy("part")).applyInArrow(compare, "a bigint, b bigint")
    return materialize(links.distinct(), "links")


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def roots(each: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, root of all nodes that are linked to others."""
    prints = ["n", *[f"s{i}" for i in range(SKETCH // 64)]]
    nodes = each.groupBy("node").agg(F.first(F.struct("n", "fp", "keys", "sketch")).alias("f"))
    nodes = nodes.select("node", "f.*").join(balls(each), "fp", "left")
    keys = F.array_prepend("keys", F.coalesce("ball", "fp")).alias("keys")  # the bucket of the SimHash, then the segments
    nodes = materialize(nodes.select("node", "n", keys, *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64)]), "nodes")
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(keys.join(shared, "key"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    centre = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.weight").alias("weight"))
    centre = materialize(centre, "centres")
    met = shared.join(centre, "key").where("node <> centre").select("node", F.col("centre").alias("hub"), "weight").distinct()
    a, b = (nodes.select(F.col("node").alias(x), *prints).alias(x) for x in ("node", "hub"))
    stars = met.join(a, "node").join(b, "hub").where(_near("node", "hub", similar)).select("node", "hub", F.col("node.n").alias("n"), "weight")
    stars = materialize(stars, "pairs")
    bodies = _bodies(_ends(stars), docs)
    # each node meets the centre that most share; its others only where they are in another component by then
    first = stars.groupBy("node", "n").agg(F.max_by("hub", F.struct("weight", "hub")).alias("hub"))
    links = _verified(first.select("node", "hub", "n"), bodies, similar)
    rooted = materialize(_roots(links), "roots")
    apart = stars.join(first, ["node", "hub"], "left_anti")
    for end in ("node", "hub"):
        root = rooted.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        apart = apart.join(root, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    apart = materialize(apart.where("node_root <> hub_root").select("node", "hub", "n"), "pairs")
    links = links.union(_verified(apart, bodies, similar))
    rooted = materialize(_roots(links), "roots")
    found = shared.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    middle = centre.withColumnRenamed("centre", "node").join(rooted, "node", "left").select("key", F.coalesce("root", "node").alias("mid"))
    mixed = found.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = found.join(mixed, "key", "left_semi").join(middle, "key").select("key", "band", "node", "root", "mid")
    open_ = materialize(open_.join(nodes, "node"), "open-buckets")
    # those outside the centre's component meet each other once, and all inside it
    outer, other = open_.where("root <> mid").alias("o"), open_.alias("p")
    once = (F.col("p.root") == F.col("p.mid")) | (F.col("o.node") < F.col("p.node"))
    fits = (F.col("o.root") != F.col("p.root")) & once & _near("o", "p", similar) & _first_shared("o", "p")
    rest = outer.join(other, (F.col("o.key") == F.col("p.key")) & fits)
    rest = rest.select(F.col("p.node").alias("node"), F.col("o.node").alias("hub"), F.col("p.n").alias("n")).distinct()
    rest = materialize(rest, "pairs")
    bodies = bodies.unionByName(_bodies(_ends(rest).join(bodies.select("node"), "node", "left_anti"), docs))
    return _roots(links.union(_verified(rest, bodies, similar)))


def members(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Which node each row has (doc_id, node, row), and which row each node's group keeps (node, kept_id,
    kept_node, kept_row, n: how many rows equal that one). Both are written to the shared folder, so no link
    is lost; rows are not joined with their groups, so a large group of copies is no task of its own."""
    each = materialize(_fingerprints(docs), "segments")
    rows = each.groupBy("node", "doc_id", "row").agg(F.count("*").alias("n"))
    found = materialize(roots(each, docs, similar), "groups")
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "node", "n")).alias("first"))
    first = materialize(first.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "first-rows")
    best = first.groupBy("root").agg(F.min("first").alias("kept"))
    kept = [F.col(f"kept.{c}").alias(k) for c, k in (("doc_id", "kept_id"), ("node", "kept_node"), ("row", "kept_row"), ("n", "n"))]
    return each.select("doc_id", "node", "row"), materialize(first.select("node", "root").join(best, "root").select("node", *kept), "near-copies")


def keep_first(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each group of near copies, all columns."""
    _, groups = members(docs, similar)
    best = groups.where("node = kept_node").select("node", F.col("kept_row").alias("hash"), "n")
    # whole rows in one column, so that no name of theirs can clash
    held = docs.select(_node().alias("node"), F.xxhash64(*_columns(docs)).alias("hash"), F.struct(*_columns(docs)).alias("row"))
    kept = held.join(best, ["node", "hash"])
    once = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["node"]))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

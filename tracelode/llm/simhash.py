"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into `k` blocks. Two fingerprints at Hamming distance d or less differ in at most d
blocks, so they agree on some k-d of them: each fingerprint is filed under every choice of k-d blocks (d=2, k=4:
six tables with 32-bit keys), tables are joined on those keys, and pairs are verified by their Hamming distance.

No group is ever expanded into all pairs. Equal fingerprints collapse before anything else. A key with at most
`bucket` fingerprints gives at most that many candidates a row; a key with more (a large group of near copies)
is resolved exactly without pairs for d<=2: each of its fingerprints is filed under itself and its single-bit
neighbours inside the blocks that may differ, and two fingerprints are within distance 2 exactly if they share
such a point, so linking every fingerprint to the smallest one at each of its points keeps all connections.

Components come from alternating large-star and small-star steps on written tables; stars are reduced by
partial minima, so that a hub costs its neighbours one row each.

Defined cases: null or wordless texts have fingerprint zero and link like any other; repeated rows get one
component; a null doc_id counts as larger than all others; empty tables give no rows; other columns are dropped
by `simhash_components` and pass through `drop_near_duplicates`.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import LOWER_AZ, add_columns, broadcast_value, numbered, renamed, slices, written

BITS = 64
#: Shingles hashed at once; bounds a task's memory for any length of text.
SLICE = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of text's `size`-word shingles."""
    words = text.encode().translate(LOWER_AZ).split() if text else []
    n = len(words)
    if not n:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = starts + lengths
    if n >= size:
        starts, ends = starts[: n - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SLICE):
        s, e = starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist()
        h = np.fromiter((digest(data[a:b], seed) for a, b in zip(s, e)), np.uint64, len(s))
        total += _bit_counts(h)
    bits = np.packbits(2 * total > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit: bytes are counted first, so that bits are unpacked for 256 values only."""
    by_byte = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        return np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts = np.stack([np.bincount(by_byte[:, i], minlength=256) for i in range(8)])
    return (counts @ _BYTE_BITS).reshape(-1)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """docs plus fp, a signed 64-bit fingerprint."""
    return add_columns(docs, [text], lambda: lambda t: (fingerprint(t, size, seed),), "fp long")


def _block_masks(k: int) -> list[int]:
    edges = [BITS * i // k for i in range(k + 1)]
    return [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(fps: DataFrame, distance: int = 2, k: int = 4, bucket: int = 32) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints fp of fps, that connect all within `distance`.

    Every pair within distance is linked directly or, inside keys of more than `bucket`, by a path of such links.
    """
    if not 0 <= distance <= 2 or k <= distance:
        raise ValueError("distance must be 0 to 2 and smaller than k")
    masks = _block_masks(k)
    tables = [sum(masks[i] for i in chosen) for chosen in combinations(range(k), k - distance)]
    filed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)])).alias("f")).select("fp", "f.t", "f.key")
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(filed.join(sizes, ["t", "key"]), "simhash-buckets")
    small, large = sized.where(F.col("n") <= bucket), sized.where(F.col("n") > bucket)
    pairs = (
        small.select("t", "key", F.col("fp").alias("a"))
        .join(small.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where("a < b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    flips = [_signed(1 << i) for i in range(BITS)]
    free = [F.array(F.lit(0).cast("long"), *[F.lit(f) for i, f in enumerate(flips) if not m >> i & 1]) for m in tables]
    flip: Column = F.element_at(F.array(*free), F.col("t") + 1)
    # Two fingerprints that share a point are within two single-bit steps of each other.
    points = large.select("fp", "t", F.explode(flip).alias("x")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    least = points.groupBy("t", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(least, ["t", "point"]).where("a < fp").where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b)."""
    state = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = e.agg(state).first()
    for _ in range(max_rounds):
        # Large star: the larger neighbours of each node move to its least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of each node move to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.where("u <> v").distinct(), "components")
        after = e.agg(state).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 2, k: int = 4, bucket: int = 32) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    each = written(fingerprints(docs.select("doc_id", "text"), size=size).select("doc_id", "fp"), "simhash")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(close_links(fps, distance, k, bucket))
    of_fp = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = of_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = of_fp.join(ids, "root").select("fp", "component_id")
    # Copies share a fingerprint: a fingerprint has one row in `linked`, so hot ones are split by the engine's skew join.
    return each.join(linked, "fp").select("doc_id", "fp", "component_id")


#: Odd multipliers of a common 64-bit mixer.
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a parity bitmap, a power of two.
PARITY_BITS = 1024
#: Documents whose shingles are counted for the order of shingles, and how many of those shingles are kept.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 200_000
HUBS = 3
#: Digests that may be broadcast at once (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Members compared with one hub in one group; a hub of more members is copied to several groups.
HUB_MEMBERS = 256


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of text's word shingles, ascending; a text of fewer words is one shingle."""
    words = text.encode().translate(LOWER_AZ).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(size, len(h))):
            x = (x ^ h[i : i + n]) * _MIX_A
            x = (x ^ (x >> np.uint64(29))) * _MIX_B
            x ^= x >> np.uint64(32)
    return np.unique(x)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of h in one order of all shingles, rare ones first: sets of at least `similarity` share one of them.

    `common` holds, ascending, shingles known to be frequent, with their counts. Any order is exact, a good one spares work.
    """
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
    return h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def parities(h: np.ndarray) -> np.ndarray:
    """How often, odd or even, each bit is hit by h: sets with d different members differ in at most d bits."""
    hit = np.bincount((h & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(hit.astype(bool), bitorder="little").view("<i8")


def majority(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of hashes h; 0 for none."""
    return int(np.packbits(2 * _bit_counts(h) > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0


def _digest(text: str | Column = "text") -> Column:
    """A text's identity, 128 bits wide; null texts are empty ones."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than two documents of a bounded sample, and their counts. Decides the order of shingles only."""
    share = min(1.0, ORDER_DOCS / max(docs.count(), 1))
    sample = docs.select("text").where(F.pmod(F.xxhash64(F.lit(3), F.coalesce("text", F.lit(""))), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    each = add_columns(sample, ["text"], lambda: lambda t: (shingle_hashes(t, size).view(np.int64),), "s array<long>").select(F.explode("s").alias("x"))
    rows = each.groupBy("x").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "x").limit(ORDER_SHINGLES).collect()
    found = np.array([r.x for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.c for r in rows], np.int64)[order]


def _near_by_size(similarity: float, a: str, b: str) -> Column:
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    return F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b) - 1e-6


def _near_by_place(similarity: float, a: str, b: str) -> Column:
    """False only if two sets of `similarity` cannot have their first common shingle at these places of their orders."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return _near_by_size(similarity, a, b) & (left >= similarity / (1 + similarity) * (size_a + size_b) - 1e-6)


def _near_by_parity(similarity: float, a: str, b: str) -> Column:
    """False only for sets with more odd bits apart than sets of `similarity` may differ in."""
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def _unordered(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Candidates (a, b) by SimHash: nodes of one fingerprint with the least of them, and those of close fingerprints."""
    hubs = written(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "near-fingerprints")
    members = nodes.select("fp", "node").join(hubs, "fp").where("node <> hub").select(*_unordered("node", "hub"))
    close = close_links(hubs.select("fp"), distance)
    close = close.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    return members.unionByName(close.select(*_unordered("x", "y")))


def file_under_prefixes(nodes: DataFrame) -> DataFrame:
    """(key, pos, node, size, n): each node under those of its keys that others share, n of them; pos is the key's place."""
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "pos", "node", "size", "n")


def star_links(filed: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): a few nodes of each key, chosen alike in all keys, with every other one of it; linear in its size."""
    hubs = filed.groupBy("key").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "pos", "size")).alias(f"h{i}") for i in range(HUBS)])
    hubs = hubs.select("key", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("hub")).select("key", "hub.*").alias("h")
    pairs = filed.alias("f").join(hubs, "key").where("f.node <> h.node").where(_near_by_place(similarity, "f", "h"))
    return pairs.select(*_unordered("f.node", "h.node"))


def open_links(filed: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): all pairs of one key that no component joins yet and that sizes, places and parities leave possible.

    Most members of a large group are in one component by now: pairs are formed from the other ones only. No key and
    no member is left out.
    """
    # Keys of two nodes had their only pair looked at as a star.
    rooted = filed.where("n > 2").join(roots, "node", "left").select("key", "pos", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("m.root").alias("main"))
    rows = rooted.join(main, "key").join(nodes.select("node", "size", "bits"), "node")
    rows = written(rows.select("key", "pos", "node", "root", (F.col("root") == F.col("main")).alias("in_main"), "size", "bits"), "near-open")
    x, y = rows.where("not in_main").alias("x"), rows.alias("y")
    once = F.col("y.in_main") | (F.col("x.node") < F.col("y.node"))
    may = _near_by_place(similarity, "x", "y") & _near_by_parity(similarity, "x", "y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & may).select(*_unordered("x.node", "y.node"))


def _texts_of(edges: DataFrame, nodes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(node, text) of the nodes of edges."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = written(nodes.select("node", "digest").join(ends, "node", "left_semi"), f"{name}-ends")
    side = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    found = texts.select(_digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text")).join(side, "digest")
    # Copies of a text meet in each task first, so that a text with many of them is sent once a task.
    return written(found.groupBy("node").agg(F.first("text").alias("text")), f"{name}-texts")


def near_pairs(edges: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those edges (a, b) whose texts, of (node, text), have at least `similarity` of their shingles in common.

    The end with more edges is the hub. Rows are sorted by hub, the hub's own text first, and read as a stream: a task
    holds one hub's shingles and one member's at a time. A hub of many members is copied to several groups.
    """
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    both = edges.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    stars = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("d"))
    stars = stars.select("hub", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / HUB_MEMBERS)).alias("part"))
    members = stars.join(texts, "node").select("hub", "part", "node", "text")
    hubs = stars.select("hub", "part").distinct().join(texts.select(F.col("node").alias("hub"), "text"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "text")

    def check(batches):
        hub, mine = None, np.zeros(0, np.uint64)
        for b in slices(batches):
            a, other = [], []
            for h, node, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                got = shingle_hashes(text, size)
                if node is None:
                    hub, mine = h, got
                    continue
                if h != hub:
                    raise ValueError("a member came before its hub")
                common = len(np.intersect1d(mine, got, assume_unique=True))
                if common >= similarity * (len(mine) + len(got) - common) - 1e-9:
                    a.append(min(h, node))
                    other.append(max(h, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    # Null nodes, the hubs themselves, sort first.
    return members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "node").mapInArrow(check, "a long, b long")


def _near_nodes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(digest, first_id, root): each distinct text, its least doc_id, and the component of near copies it is in."""
    spark, texts = docs.sparkSession, docs.select("doc_id", "text")
    common, counts = _common_shingles(texts, size)
    shared = broadcast_value(spark, (common, counts), 16 * ORDER_SHINGLES, common.nbytes + counts.nbytes, "order of shingles")

    def sketch():
        order = shared.value

        def run(text):
            h = shingle_hashes(text, size)
            # Texts without words are alike: key 0 stands for the empty set.
            keys = prefix(h, similarity, *order).view(np.int64) if len(h) else [0]
            return len(h), majority(h), parities(h), keys

        return run

    each = add_columns(texts, ["text"], sketch, "size long, fp long, bits array<long>, keys array<long>")
    each = each.select(_digest().alias("digest"), "doc_id", "size", "fp", "bits", "keys")
    nodes = each.groupBy("digest").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "fp", "bits", "keys")])
    # Written once, so that the numbers stay what they are.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    filed = written(file_under_prefixes(nodes), "near-filed")
    side = nodes.select("node", "size", "bits")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        x, y = side.alias("x"), side.alias("y")
        left = candidates.distinct().join(x, F.col("a") == F.col("x.node"))
        may = _near_by_size(similarity, "x", "y") & _near_by_parity(similarity, "x", "y")
        edges = written(left.join(y, (F.col("b") == F.col("y.node")) & may).select("a", "b"), f"{name}-candidates")
        return written(near_pairs(edges, _texts_of(edges, nodes, texts, name), size, similarity), name)

    # Close fingerprints and stars first: most members of a group are then joined, and only pairs of different components are left.
    first = verified(fingerprint_links(nodes).unionByName(star_links(filed, similarity)), "near-first")
    rest = verified(open_links(filed, components(first), nodes, similarity), "near-rest")
    roots = components(first.unionByName(rest))
    return nodes.select("digest", "node", "first_id").join(roots, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root"))


def near_components(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): components over links of word-shingle similarity (Jaccard) of at least `similarity`.

    SimHash fingerprints of the shingles, joined on blocks, give the first candidates. Near copies with words added or
    cut often lie more than two bits apart, so the rest comes from an exact prefix join: with all shingles in one order,
    sets of at least that similarity share one of the first n - ceil(similarity n) + 1 shingles of each. The order
    (frequent shingles last, by a sample) decides only how many false candidates there are; sizes, places and parities
    rule most of those out without loss, and what is left is verified on the shingles of both texts.
    """
    of_text = _near_nodes(docs, size, similarity)
    ids = of_text.groupBy("root").agg(F.min("first_id").alias("component_id"))
    each = docs.select("doc_id", _digest().alias("digest"))
    return each.join(of_text.join(ids, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest doc_id, null being the largest, then of the least digest.

    Texts are told apart by their digest and not by doc_id: different texts with one doc_id, or without any, all stay.
    """
    of_text = _near_nodes(docs, size, similarity)
    least = of_text.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest")).alias("m"))
    # A row's key holds its doc_id, so that the rows of one text spread; a null one is told from any number by a column of its own.
    key, mine = ["digest", "none", "id"], numbered(docs)
    doc_id, text = (F.col(f"d_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    name = lambda digest, at: [digest.alias(key[0]), at.isNull().alias(key[1]), F.coalesce(at, F.lit(0)).alias(key[2])]
    heads = least.select(*name(F.col("m.digest"), F.col("m.first_id")))
    marked = mine.select("*", *name(_digest(text), doc_id))
    return renamed(marked.join(heads, key, "left_semi").dropDuplicates(key), docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's set are its distinct shingles of words, lower-cased in A-Z. One hash of every shingle
deals the set into bins; the least hash of each bin is its value, and an empty bin takes the value of
the first non-empty bin in its own fixed random order. Bands of bins are the buckets. Documents with
equal sets are one class and are represented by one node, so copies make no pairs.

Candidates are stars: each bucket links its members to one hub, so a bucket of m members makes m - 1
pairs. Links are confirmed on the full sets of both texts and joined to components. Buckets whose
members then lie in several components get another, random hub, as long as that joins a good part of
them. What is then still apart is nearly always so: near the threshold, but below it. It is settled
by the rarest shingles: sets of sizes n <= m that are alike to t have a shingle in common among the
first n - ceil(2 t n / (1 + t)) + 1 of the one and the first m - ceil(t m) + 1 of the other, whatever
the order of all shingles is, and in order of frequency these are shingles that few others have. A
part common to many sets is not among the former, unless it makes them alike. Larger sets have some
shingles more there, and must then have as many more in common. Members of different components that
meet so are compared, as
pairs where at most ``PAIR_GROUP`` members meet, else in blocks of bounded size that count common
shingles through an index and give out links alone. So every pair that shares a bucket is confirmed,
in one component anyway, or proven apart, with work that grows with the members and not with their
square; no cap applies. Buckets with very many members are dealt to several tasks.

Bins of a band and bands are chosen so that a pair at the threshold shares no bucket with a
probability of ``MISS`` at most: 32 bands of 6 bins for 0.85, 38 of 5 for 0.8. Shingles are told apart
by 64-bit hashes.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing
and is its own component; one with fewer words than a shingle has its whole sequence of words as its
only shingle; rows with a null id are linked with nothing and are kept; repeated rows are one
document; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import dealt_join, materialize, text_or_empty
from terrashift.llm.components import connected_components

#: Chance that a pair at the threshold shares no bucket.
MISS = 3e-7
#: Turns of hubs at least; a further one follows one that made links for this share of the members.
TURNS, WORTH = 2, 0.1
#: Shingles and members of a block of comparisons, members of a rare shingle that are compared as pairs, slots of shingle frequencies.
BLOCK_SHINGLES, BLOCK_MEMBERS, PAIR_GROUP, SLOT_BITS = 300_000, 512, 256, 20
#: Rare shingles that a pair must share: one for each so many of the smaller set, but no more than a few.
SHARED_EACH, SHARED_MOST = 64, 4

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) + y
    x = x * _MIX[1]
    return (x ^ (x >> np.uint64(32))) * _MIX[2]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text.

    Lower-casing and splitting bytes touches A-Z and U+0009..U+000D and the space alone.
    """
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out, h[k : k + n])
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a non-empty one; the same in every process."""
    return np.stack([np.random.default_rng(7_919 + b).permutation(bins) for b in range(bins)])


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the densified one-permutation sketch of a non-empty set."""
    bins = bands * rows
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascending, as the hashes are
    first = np.searchsorted(place, np.arange(bins + 1, dtype=np.uint64))
    full = first[:-1] < first[1:]
    values = shingles[np.minimum(first[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        orders = _orders(bins)[empty]
        donors = orders[np.arange(len(empty)), full[orders].argmax(axis=1)]
        values[empty] = values[donors]
    out = np.arange(bands, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        out = _mix(out, column)
    return out


def layout(threshold: int) -> tuple[int, int]:
    """Bands and bins of a band for a threshold in per cent: a band agrees for about a third of the pairs there."""
    t = threshold / 100
    rows = max(1, round(math.log(0.36) / math.log(t))) if t < 1 else 8
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(t**rows)))) if t < 1 else 1, rows


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        sizes, hashes, banded = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_buffer().to_pybytes(), words)
            sizes.append(len(s))
            hashes.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
            banded.append(band_hashes(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(banded, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_hash", "bands"],
        )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [press(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["node", "packed"])


def sketches(docs: DataFrame, words: int, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands) of each row; set_hash is null for an empty set."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return plain.mapInArrow(lambda b: _sketch(b, words, bands, rows), "doc_id long, n_shingles long, set_hash binary, bands array<bigint>")


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n"), *more)


def _distinct_groups(members: DataFrame, *told_by: Column) -> DataFrame:
    """(key, node, ..., alike) of all keys of two members or more; of ``alike`` keys with the same members one stays."""
    hashes = [F.bit_xor(F.xxhash64("node", *told_by, F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    alike = _counted(members, *hashes).filter("n > 1")
    kept = alike.groupBy("n", "h0", "h1").agg(F.min("key").alias("key"), F.count("*").alias("alike")).select("key", "n", "alike")
    return dealt_join(members, materialize(kept, "minhash-groups"), "key", "n", "node").drop("n")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node) of all buckets of two nodes or more, those of equal members once."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = materialize(_counted(rows).filter("n > 1"), "minhash-shared")
    return _distinct_groups(materialize(dealt_join(rows, shared, "key", "n", "node").drop("n").distinct(), "minhash-members")).drop("alike")


def _mixed(members: DataFrame) -> DataFrame:
    """The members (key, node, component) of keys with several components."""
    open_keys = _counted(members, F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "n")
    return dealt_join(members, open_keys, "key", "n", "node").drop("n")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))


def _star_pairs(open_members: DataFrame, turn: int) -> DataFrame:
    """(a, b): the members of each open bucket and its hub of this turn, where their components differ."""
    rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = _counted(open_members, F.min(F.struct(rank.alias("rank"), "node", "component")).alias("h")).select("key", "n", F.col("h.node").alias("hub"), F.col("h.component").alias("hub_component"))
    return dealt_join(open_members, hubs, "key", "n", "node").filter("component <> hub_component").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _slot_counts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack, counts = zstandard.ZstdDecompressor().decompress, np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for packed in batch.column("packed"):
            slots = (shingle_set(unpack(packed.as_buffer().to_pybytes()), words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            np.add.at(counts, slots, 1)
    used = np.flatnonzero(counts)
    for i in range(0, len(used), 10_000):
        part = used[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])


def _rarity(texts: DataFrame, words: int) -> np.ndarray:
    """For each slot of shingle hashes how frequent it is, on a scale of logarithms: one megabyte, whatever the input is."""
    counts = texts.select("packed").mapInArrow(lambda b: _slot_counts(b, words), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.filter("n > 1").select(F.col("slot").cast("int").alias("slot"), F.floor(4 * F.log2("n")).cast("tinyint").alias("level")).toArrow()  # a row for each slot at most
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels


def must_share(size: int, threshold: int) -> int:
    """How many rare shingles a set of this size shares with any no smaller one that is alike to it."""
    return min(SHARED_MOST, 1 + size // SHARED_EACH, -(-2 * threshold * size // (100 + threshold)))


def prefix(shingles: np.ndarray, threshold: int, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, and how many of them count towards sets that are no smaller.

    Of two sets that are alike to ``threshold`` per cent, :func:`must_share` of the smaller's that count
    are among the larger's.
    """
    n = len(shingles)
    more = must_share(n, threshold)
    size, counting = n - -(-threshold * n // 100) + more, n - -(-2 * threshold * n // (100 + threshold)) + more
    order = np.lexsort((shingles, levels[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return shingles[order[:size]], counting


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, threshold: int, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        found = [prefix(shingle_set(unpack(p.as_buffer().to_pybytes()), words), threshold, levels) for p in batch.column("packed")]
        columns = {
            "node": batch.column("node"), "component": batch.column("component"), "n_shingles": batch.column("n_shingles"),
            "keys": pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64())), "counting": pa.array([c for _, c in found], pa.int32()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _rare_members(open_members: DataFrame, texts: DataFrame, sizes: DataFrame, words: int, threshold: int) -> DataFrame:
    """(key, node, component, n_shingles, asks) of the rarest shingles of all open members, where several components meet in one.

    ``asks``: whether the shingle counts for the member; a key without such a member is dropped.
    """
    nodes = open_members.select("node", "component").distinct().join(sizes, "node")
    held = materialize(texts.join(nodes, "node"), "minhash-rest")
    levels = _rarity(held, words)
    schema = "node long, component long, n_shingles long, keys array<bigint>, counting int"
    keys = held.select("node", "component", "n_shingles", "packed").mapInArrow(lambda b: _prefixes(b, words, threshold, levels), schema)
    exploded = keys.select("node", "component", "n_shingles", "counting", F.posexplode("keys").alias("at", "key"))
    rows = materialize(exploded.select("key", "node", "component", "n_shingles", (F.col("at") < F.col("counting")).alias("asks")), "minhash-rare")
    asked = _counted(rows, F.max("asks").alias("asked"), F.min("component").alias("low"), F.max("component").alias("high")).filter("asked AND low < high").select("key", "n")
    met = materialize(dealt_join(rows, materialize(asked, "minhash-asked"), "key", "n", "node").drop("n"), "minhash-met")
    return materialize(_distinct_groups(met, F.col("asks")), "minhash-groups")


def _pairs(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of different components that share enough keys, ``a`` one that asks and no larger than ``b``; no key has more than ``PAIR_GROUP`` members."""
    side = lambda rows, name: rows.select("key", F.struct("n_shingles", "node").alias(name), F.col("component").alias(f"of_{name}"), F.col("alike").alias(f"alike_{name}"))
    sized = F.col("a.n_shingles") * 100 >= F.col("b.n_shingles") * threshold
    met = side(members.filter("asks"), "a").join(side(members, "b"), "key").filter("a < b AND of_a <> of_b").filter(sized)
    size = F.col("a.n_shingles")
    least = F.least(F.lit(SHARED_MOST), 1 + F.floor(size / SHARED_EACH), F.ceil(2 * threshold * size / (100 + threshold)))
    return met.groupBy("a", "b").agg(F.sum("alike_a").alias("shared")).filter(F.col("shared") >= least).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(family, query_block, member_block, is_member, node, component): who meets whom under each key.

    The members that ask are a query set that meets all members.
    """
    asked = F.sum(F.when(F.col("asks"), F.col("n_shingles")).otherwise(0))
    count = lambda c, n: F.greatest(F.lit(1), F.ceil(c / block), F.ceil(n / BLOCK_MEMBERS)).cast("int")
    whole = _counted(members, count(asked, F.count_if("asks")).alias("query_blocks"), count(F.sum("n_shingles"), F.count("*")).alias("member_blocks"))
    rows = dealt_join(members, whole, "key", "n", "node").withColumnRenamed("key", "family")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_members = rows.select("family", every("query_blocks").alias("query_block"), own("member_blocks").alias("member_block"), F.lit(1).alias("is_member"), "node", "component")
    as_queries = rows.filter("asks").select("family", own("query_blocks").alias("query_block"), every("member_blocks").alias("member_block"), F.lit(0).alias("is_member"), "node", "component")
    return as_members.unionByName(as_queries)


def _star_blocks(pairs: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """As ``_blocks``: each hub ``a`` is the one query that meets its members ``b``."""
    members = pairs.select(F.col("a").alias("family"), F.col("b").alias("node")).join(sizes, "node")
    parts = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n_shingles") / block), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int").alias("member_blocks"), F.count("*").alias("n"))
    rows = dealt_join(members, parts, "family", "n", "node")
    kind = lambda n: [F.lit(n).alias("is_member"), "node", F.col("node").alias("component")]
    as_members = rows.select("family", F.lit(0).alias("query_block"), F.pmod(F.xxhash64("node"), F.col("member_blocks")).cast("int").alias("member_block"), *kind(1))
    hubs = parts.select("family", F.lit(0).alias("query_block"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("member_block"), F.col("family").alias("node"))
    return as_members.unionByName(hubs.select("family", "query_block", "member_block", *kind(0)))


def _meet(rows: list[tuple], words: int, numerator: int) -> tuple[list[int], list[int]]:
    """Links between the queries and the members of one block that are of different components."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    queries, members = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    if not queries or not members:
        return [], []
    sets = [shingle_set(unpack(r[3]), words) for r in members]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    index, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    nodes, components = np.array([r[1] for r in members], np.int64), np.array([r[2] for r in members], np.int64)
    marked = np.zeros(len(index), bool)
    a, b = [], []
    for _, node, component, packed in queries:
        own = shingle_set(unpack(packed), words)
        at = np.minimum(np.searchsorted(index, own), len(index) - 1)
        at = at[index[at] == own]
        marked[at] = True
        both = np.add.reduceat(marked[ids].astype(np.int64), starts)
        marked[at] = False
        linked = (100 * both >= numerator * (len(own) + sizes - both)) & (components != component)
        found = nodes[linked].tolist()
        a += [node] * len(found)
        b += found
    return a, b


def _meetings(batches: Iterator[pa.RecordBatch], words: int, numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block."""
    block, rows = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _meet(rows, words, numerator)], names=["a", "b"])
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("family", "query_block", "member_block", "is_member", "node", "component", "packed"))
        for family, q, m, *row in zip(*columns, strict=True):
            if block != (family, q, m):
                if rows:
                    yield out()
                block, rows = (family, q, m), []
            rows.append(tuple(row))
    if rows:
        yield out()


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    ``threshold`` is a percentage: sets are linked if 100 * intersection >= threshold * union.
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the row's own.
    """
    bands, rows = layout(threshold)
    sketched = materialize(sketches(docs, words, bands, rows, doc_id, text), "minhash-sketches")
    with_sets = sketched.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(with_sets.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "minhash-classes")
    members = materialize(_buckets(classes), "minhash-buckets")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    packed = plain.mapInArrow(_compress, "node long, packed binary")
    # the texts of all nodes that share a bucket, for every turn; that list has no bound, so it isn't broadcast
    texts = materialize(packed.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "minhash-texts")
    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))

    def confirmed(blocks: DataFrame) -> DataFrame:
        order = ["family", "query_block", "member_block"]
        met = blocks.join(texts, "node").repartition(*order).sortWithinPartitions(*order, "is_member")
        return materialize(met.mapInArrow(lambda b: _meetings(b, words, threshold), "a long, b long"), "minhash-links")

    labels: DataFrame | None = None

    def joined(links: DataFrame) -> DataFrame:
        """Labels after the links are joined to what is known."""
        if labels is None:
            return materialize(connected_components(links), "minhash-labels")
        known = labels
        end = lambda e, side: e.join(known.select(F.col("node").alias(side), F.col("component").alias("c")), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
        lifted = connected_components(end(end(links, "a"), "b")).select(F.col("node").alias("component"), F.col("component").alias("up"))
        moved = known.join(lifted, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        fresh = lifted.select(F.col("component").alias("node"), F.col("up").alias("component"))
        return materialize(moved.union(fresh.join(known.select("node"), "node", "left_anti")), "minhash-labels")

    open_members = members.withColumn("component", F.col("node"))
    turn = 0
    while True:
        links = confirmed(_star_blocks(materialize(_star_pairs(open_members, turn), "minhash-pairs"), sizes, BLOCK_SHINGLES))
        labels = joined(links)
        open_members = materialize(_mixed(_labelled(open_members.select("key", "node"), labels)), "minhash-open")
        turn += 1
        left = open_members.select("node").distinct().count()
        if not left or (turn >= TURNS and links.count() < WORTH * left):
            break
    if left:
        rare = _rare_members(open_members, texts, sizes, words, threshold)
        few = _counted(rare).filter(F.col("n") <= PAIR_GROUP).select("key")
        small, large = rare.join(few, "key", "left_semi"), rare.join(few, "key", "left_anti").drop("alike")
        met = _star_blocks(materialize(_pairs(small, threshold), "minhash-pairs"), sizes, BLOCK_SHINGLES).unionByName(_blocks(large, BLOCK_SHINGLES).withColumn("query_block", F.col("query_block") + 1))
        labels = joined(confirmed(met))

    found = classes.select("set_hash", "node").join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    # rows with a null id are not part of any class
    rowed = sketched.select("doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long")
    return rowed.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

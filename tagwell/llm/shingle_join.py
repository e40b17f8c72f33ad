"""Self-join of documents by the Jaccard similarity of their word 5-shingles.

Documents with one set of shingles are one class, and all work is on classes. A set's shingles stand in a global
order: by hash, but those that many documents hold come last. Two classes that link share shingles among the first of both
(prefix filter; the longer the prefix, the more of them), and their sizes lie in one band or in neighbouring ones.

1. Classes that share one of their smallest shingles are compared with one of them, the pivot, which joins most groups of near copies.
2. What is left to find are links between different components. A class goes unless as many of its first shingles as any link needs are held by other components,
   too; the rest go to tiles by size band and bucket of shingles, with those first shingles and a hashed bitmap of the whole set. Tiles of too many classes are split into blocks, each two of which meet.
   In a tile, classes of different components that share a first shingle are compared: bit counts of the bitmaps bound their overlap from above, and pairs that can't reach it go.
3. Classes that the pairs left connect form groups. Their sorted arrays are intersected exactly, in blocks of bounded size, each two of which meet; two blocks give
   the components of their links, not the links.
4. Any link lies within a component of the links found so far, so for the number of links each component's classes meet in blocks, too.

Nothing is left out of a tile or block, so components and numbers of links are those of all pairs. Sorted arrays are made for classes that may link
only, once, and travel with them.

Shingles are 64-bit hashes, classes are told apart by 64 bits of their set's digest.

Defined results: documents without words (null, empty, white space) have no shingles, no links, and are alone; fewer than five words are one shingle; texts of
any length are taken whole; repeated rows are one class and link with each other; a null doc_id takes part, but is no component_id unless its component has no other; other columns are not
read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwell.llm.common import cut, release, sized_partitions, slices, table, tidy
from tagwell.llm.graph import components, hung

WORDS, PERCENT = 5, 75
KEYS, LONGER = 4, 5
FREQUENT, LEAST_FREQUENT, MOST_FREQUENT = 1 / 2000, 24, 1 << 17
COUNT_SHINGLES = 1_000_000
TILE_POSTINGS, TILE_CLASSES, PAIRS_AT_ONCE = 750_000, 100_000, 500_000
BLOCK_CLASSES, BLOCK_SHINGLES, SLICE_BITS = 1024, 500_000, 1 << 16
PIVOT_CLASSES = 256
MOST_BITS = 1 << 14
LONGEST = 1 << 12
BROADCAST_ROWS = 1_000_000
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, 0 for white space; whether it is white space; powers of a random odd number."""
    rng = np.random.default_rng(6)
    values, white = rng.integers(1, 1 << 64, 256, np.uint64), np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    values[white] = 0
    return values, white, np.cumprod(np.full(LONGEST, int(rng.integers(1, 1 << 62)) * 2 + 1, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (between ASCII white space, A-Z lower-cased), in order: a polynomial of its bytes, for all words at once."""
    a = np.frombuffer(data.lower(), np.uint8)
    values, white, powers = letters()
    gap = white[a]
    inner = ~gap
    starts = np.flatnonzero(inner & np.concatenate([[True], gap[:-1]])) if len(a) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.flatnonzero(inner & np.concatenate([gap[1:], [True]])) + 1 - starts
    at = np.flatnonzero(inner)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    long = np.flatnonzero(lengths > LONGEST)
    h = np.add.reduceat(values[a[at]] * powers[np.minimum(place, LONGEST - 1) if len(long) else place], first)
    h ^= lengths.astype(np.uint64) * ODD[2]
    h ^= h >> np.uint64(30)
    h *= ODD[1]
    h ^= h >> np.uint64(27)
    for k in long:
        h[k] = xxhash.xxh64_intdigest(a[starts[k] : starts[k] + lengths[k]].tobytes())
    return h


def shingles(text: str | None) -> np.ndarray:
    """The text's set of shingles as sorted hashes."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    if len(w) < WORDS:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), len(w))], np.uint64)
    n = len(w) - WORDS + 1
    s = w[:n] * ODD[0]
    for k in range(1, WORDS):
        s += w[k : k + n] * ODD[k]
    s ^= s >> np.uint64(31)
    s *= ODD[1]
    s ^= s >> np.uint64(29)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def held_by(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of y are in the sorted array x."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted arrays."""
    common = int(held_by(x, y).sum())
    return common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)


def least_overlap(n: int, m: int) -> int:
    """Of linked sets with n and m elements."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def more(n: int) -> int:
    """Sets of at least n that link share this many first shingles besides one, for their prefixes are longer by as many."""
    return n // LONGER


def prefix(n: int) -> int:
    """How many of its first shingles a set of n may share with a smaller one."""
    return n - -(-PERCENT * n // 100) + 1 + more(n)


def short_prefix(n: int) -> int:
    """And with one of its size or larger."""
    return n - least_overlap(n, n) + 1 + more(n)


def least_shared(n: int) -> int:
    """First shingles that a set of n shares with any that it links with."""
    return 1 + more(-(-PERCENT * n // 100))


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Smallest size of each band; sets two bands apart can't link."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // PERCENT)))
    return np.array(out)


def band_of(n: int) -> int:
    return int(np.searchsorted(bands(), n, "right")) - 1


def bits_of(band: int) -> int:
    """Bits of the bitmaps of a tile whose larger sets are of this band: twice the size, a power of two."""
    return min(MOST_BITS, max(64, 1 << int(2 * bands()[band + 1] - 1).bit_length()))


def bitmap(s: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(n_bits, np.uint8)
    bits[(s >> np.uint64(7)) & np.uint64(n_bits - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n_bits: int) -> np.ndarray:
    """A bitmap of fewer bits, or as it is."""
    return np.bitwise_or.reduce(words.reshape(-1, n_bits // 64), 0) if len(words) * 64 > n_bits else words


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that more than about FREQUENT of the documents hold, sorted; the MOST_FREQUENT of them, if there are more.

    They only set the global order, which any set of shingles could, so results don't depend on them. Such a shingle is as frequent in some
    block of rows; blocks give theirs, and the sums decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(LEAST_FREQUENT // 3, FREQUENT * len(held))
            size = np.array([len(held)], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], 0).astype(np.int64)), pa.array(np.append(np.zeros(often.sum(), np.int64), size))], names=["shingle", "n", "docs"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py()))
                size += len(held[-1])
                if size >= COUNT_SHINGLES:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()
        held.clear()
        release()

    counts = cut(docs.select("text").mapInArrow(run, "shingle long, n long, docs long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    often = counts.where(F.col("n") >= max(LEAST_FREQUENT, FREQUENT * total / 2)).orderBy(F.col("n").desc(), "shingle").limit(MOST_FREQUENT)
    return np.sort(often.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, node and n of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(node_of(s) if len(s) else None, len(s)) for s in (shingles(text.as_py()) for text in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())], names=["doc_id", "node", "n"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n int")


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to drop shingles by, for equal ones stay equal."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def describe(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, row (its key), node (the class), n, keys (smallest shingles), first (the prefix in the global order, packed) and bits (the bitmap for the next band's tiles); a task gives a class's arrays once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, rows = whole.slice(at, 1024), []
                for text in batch.column(2):
                    s = shingles(text.as_py())
                    node = node_of(s) if len(s) else None
                    if node is None or node in given:
                        rows.append((node, len(s), None, None, None))
                        continue
                    if len(given) < 100_000:
                        given.add(node)
                    last = held_by(frequent, s)
                    rows.append((node, len(s), s[:KEYS].view(np.int64), packed(np.concatenate([s[~last], s[last]])[: prefix(len(s))]), bitmap(s, bits_of(band_of(len(s)) + 1)).tobytes()))
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "row", "node", "n", "keys", "first", "bits"])
        release()

    return keyed(docs).mapInArrow(run, "doc_id long, row long, node long, n int, keys array<long>, first binary, bits binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def arrays(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and set (the sorted array) of these classes, each from the text of one row. Up to BROADCAST_ROWS keys of rows are broadcast; beyond that, texts are shuffled by key."""
    wanted = cut(nodes.select("node").distinct().join(classes.select("node", F.col("row").alias("of")), "node"))
    sent = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    texts = keyed(docs).join(sent, F.col("row") == F.col("of")).groupBy("node").agg(F.max("text").alias("text"))  # equal rows once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(text.as_py()).tobytes() for text in batch.column(1)], pa.binary())], names=["node", "set"])
        release()

    return cut(texts.select("node", "text").mapInArrow(run, "node long, set binary"))


def shared(p: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Bits that a bitmap has in common with each of several."""
    return np.bitwise_count(maps & p).sum(1, dtype=np.int64)


def may_link(sizes: np.ndarray, maps: np.ndarray, n_own: int, same: bool, labels: np.ndarray | None = None) -> list[np.ndarray]:
    """For each of the first n_own sets the others (later ones, if all are of one block, or else of the other block) that it may link with; sets of one label aren't compared.

    Bit counts bound each overlap from above: a set has as many elements outside the other one as its bitmap has bits that the other lacks, at least.
    """
    spare = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
    start = 0 if same else n_own
    order = start + np.argsort(sizes[start:], kind="stable")
    near: list[np.ndarray] = []
    for x in range(n_own):
        least, most = -(-PERCENT * sizes[x] // 100), 100 * sizes[x] // PERCENT
        y = order[np.searchsorted(sizes[order], least) : np.searchsorted(sizes[order], most, "right")]
        fit = y > x if same else np.ones(len(y), bool)
        if labels is not None:
            fit &= labels[y] != labels[x]
        y = y[fit]
        bound = shared(maps[x], maps[y]) + np.minimum(spare[x], spare[y])
        near.append(y[(100 + PERCENT) * bound >= PERCENT * (sizes[x] + sizes[y])])
    return near


def links_within(sets: list[np.ndarray], n_own: int, same: bool, n_bits: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets that link, of those that may_link: their arrays are intersected exactly, all at once by bits of the elements that two of them hold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    near = may_link(sizes, np.stack([bitmap(s, n_bits) for s in sets]), n_own, same, labels)
    met = np.flatnonzero([len(y) > 0 for y in near])
    if not len(met):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    involved = np.unique(np.concatenate([met, *(near[x] for x in met)]))
    place = np.zeros(len(sets), np.int64)
    place[involved] = np.arange(len(involved))
    held, count = np.unique(np.concatenate([sets[k] for k in involved]), return_counts=True)
    held = held[count > 1]  # others are in no intersection
    common = {int(x): np.zeros(len(near[x]), np.int64) for x in met}
    for low in range(0, len(held), SLICE_BITS):
        part = held[low : low + SLICE_BITS]
        rows = np.zeros((len(involved), -(-len(part) // 64)), np.uint64)
        for k, i in enumerate(involved):
            bits = np.zeros(rows.shape[1] * 64, bool)
            s = sets[i]
            bits[np.searchsorted(part, s[held_by(part, s)])] = True
            rows[k] = np.packbits(bits, bitorder="little").view(np.uint64)
        for x in met:
            common[int(x)] += shared(rows[place[x]], rows[place[near[x]]])
    found_x, found_y = [], []
    for x in met:
        c, y = common[int(x)], near[x]
        y = y[(c > 0) & (100 * c >= PERCENT * (sizes[x] + sizes[y] - c))]
        found_x.append(np.full(len(y), x))
        found_y.append(y)
    return np.concatenate(found_x), np.concatenate(found_y)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that link. Pairs are dealt by b, in blocks of some PIVOT_CLASSES; a block gets b's array once and that of each a."""
    pairs = pairs.select("a", "b").distinct()
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIVOT_CLASSES).cast("int").alias("blocks")).withColumnRenamed("b", "of")
    dealt = pairs.join(blocks, F.col("b") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    needs = dealt.select("b", "block", F.col("a").alias("node"), F.lit(1).alias("part")).unionByName(dealt.select("b", "block", F.col("b").alias("node"), F.lit(0).alias("part")).distinct())
    rows = needs.join(sets, "node").select("b", "block", "part", "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.empty(0, np.uint64)
        for batch in slices(batches):
            found = []
            for b, block, part, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                if part == 0:
                    held, own = (b, block), s
                elif held == (b, block) and linked(own, s):
                    found.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return rows.repartition("b", "block").sortWithinPartitions("b", "block", "part").mapInArrow(run, "a long, b long")


def _band(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in bands()]), lambda b: b <= n)) - 1


def enough_shared(known: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Nodes of the classes that share as many of their first shingles with other components as any link between them needs. known: node, label, n, first.

    Rare shingles are dealt out by bucket, packed; no more than about FREQUENT of the classes hold one. Frequent shingles are few, and what they need is a minimum and a maximum of labels, which
    tasks combine. A bucket's counts are dealt out by parts of the nodes, a packed row for each, and summed there.
    """
    postings = known.agg(F.sum(F.length("first") / 6)).first()[0] or 0
    buckets, parts = 1 + int(postings) // TILE_POSTINGS, sized_partitions(known.sparkSession)
    frequent = unpacked(packed(frequent))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                parts: dict[int, list] = {}
                for node, label, first in zip(*(c.to_pylist() for c in whole.slice(at, 4096).columns), strict=True):
                    s = unpacked(first)
                    s = s[~held_by(frequent, s)]
                    bucket, top = (s >> np.uint64(16)) % np.uint64(buckets), (s >> np.uint64(32)).astype(np.uint32)
                    for k in np.unique(bucket):
                        parts.setdefault(int(k), []).append((node, label, top[bucket == k]))
                blobs = [pickle.dumps((np.array([m[0] for m in members]), np.array([m[1] for m in members]), np.array([len(m[2]) for m in members], np.int32), np.concatenate([m[2] for m in members])), 5) for members in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part"])
        release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []

        def give() -> pa.RecordBatch:
            node, label, counts, top = (np.concatenate(c) for c in zip(*blobs, strict=True))
            owner = np.repeat(np.arange(len(node)), counts)
            order = np.argsort(top, kind="stable")
            top, owner = top[order], owner[order]
            fresh = np.concatenate([[True], top[1:] != top[:-1]])
            group = np.cumsum(fresh) - 1
            own = label[owner]
            several = np.zeros(group[-1] + 1, bool)
            several[group[own != own[np.flatnonzero(fresh)][group]]] = True
            shared = np.bincount(owner[several[group]], minlength=len(node))
            found = np.flatnonzero(shared)
            return parted(node[found], shared[found])

        for batch in batches:
            for bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held and blobs:
                    yield give()
                    blobs = []
                held = bucket
                blobs.append(pickle.loads(blob))
        if blobs:
            yield give()
        blobs = []
        release()

    def parted(node: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        """A row for each of the parts that the nodes are dealt into, packed."""
        part = (node.astype(np.uint64) * ODD[0] >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        own = [order[low:high] for low, high in zip(ends[:-1], ends[1:], strict=True)]
        blobs = [np.stack([node[k], shared[k].astype(np.int64)]).tobytes() for k in own]
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero([len(k) for k in own]), pa.int32()), pa.array([b for b in blobs if b], pa.binary())], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sums = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in slices(batches, 64):
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != held and held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sums)], names=["node", "shared"])
                    nodes, sums = nodes[:0], sums[:0]
                held = part
                node, shared = np.frombuffer(blob, np.int64).reshape(2, -1)
                nodes, at = np.unique(np.concatenate([nodes, node]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, shared]), len(nodes)).astype(np.int64)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sums)], names=["node", "shared"])
        release()

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                nodes, labels, firsts = (c.to_pylist() for c in batch.slice(at, 1024).columns)
                held = [s[held_by(frequent, s)].view(np.int64) for s in map(unpacked, firsts)]
                sizes = [len(h) for h in held]
                columns = (np.concatenate(held), np.repeat(np.array(nodes), sizes), np.repeat(np.array(labels), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "node", "label"])
        release()

    rows = known.select("node", "label", "first")
    rare = rows.mapInArrow(deal, "bucket int, part binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "part int, counts binary")
    rare = rare.repartition("part").sortWithinPartitions("part").mapInArrow(total, "node long, shared long")
    often = rows.mapInArrow(common, "shingle long, node long, label long")
    between = often.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("shingle").alias("of"))
    hot = often.join(F.broadcast(between), F.col("shingle") == F.col("of"), "left_semi").select("node", F.lit(1).cast("long").alias("shared"))  # MOST_FREQUENT rows at most
    found = rare.unionByName(hot).groupBy("node").agg(F.sum("shared").alias("shared"))
    enough = F.expr(f"1 + ({PERCENT} * n + 99) div 100 div {LONGER}")  # least_shared
    return found.join(known.select("node", "n"), "node").where(F.col("shared") >= enough).select("node")


def dealt_tiles(n: int, first: np.ndarray, buckets: dict[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tiles of a class: band, bucket, the shingles there (32 bits), and which of them stand within the short prefix."""
    band, short = band_of(n), short_prefix(n) - more(n)
    s = first[: prefix(n) - more(n)]
    for t, own in ((band, s), (band + 1, s[:short])):
        bucket = (own >> np.uint64(16)) % np.uint64(buckets[t])
        for k in np.unique(bucket):
            here = np.flatnonzero(bucket == k)
            yield t, int(k), (own[here] >> np.uint64(32)).astype(np.uint32), here < short


def candidates(known: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect all that may link and are of different components. known: node, label, n, first, bits."""
    sizes = {r.band: r.postings for r in known.groupBy(_band(F.col("n")).alias("band")).agg(F.sum(F.length("first") / 6).cast("long").alias("postings")).collect()}  # a row for each band
    buckets = {t: 1 + (sizes.get(t, 0) + sizes.get(t - 1, 0)) // TILE_POSTINGS for b in sizes for t in (b, b + 1)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, k) for n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, k, _, _ in dealt_tiles(n, unpacked(first), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)], names=["tile", "bucket"])

    full = known.select("n", "first").mapInArrow(counted, "tile int, bucket int").groupBy("tile", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_CLASSES)
    blocks = {(r.tile, r.bucket): -(-2 * r.n // TILE_CLASSES) for r in full.collect()}  # a row for so many classes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                parts: dict[tuple, list] = {}
                for node, label, n, first, bits in zip(*(c.to_pylist() for c in whole.slice(at, 2048).columns), strict=True):
                    words = np.frombuffer(bits, np.uint64)
                    for t, k, shingle, is_short in dealt_tiles(n, unpacked(first), buckets):
                        m = blocks.get((t, k), 1)
                        for other in range(m):
                            i, j = sorted((node % m, other))
                            parts.setdefault((t, k, i, j), []).append((node, label, n, fold(words, bits_of(t)), shingle, is_short))
                blobs = []
                for members in parts.values():
                    c = list(zip(*members, strict=True))
                    blobs.append(pickle.dumps((np.array(c[0]), np.array(c[1]), np.array(c[2], np.int64), np.stack(c[3]), np.concatenate(c[4]), np.concatenate(c[5]), np.array([len(x) for x in c[4]])), 5))
                yield pa.RecordBatch.from_arrays([*(pa.array([p[x] for p in parts], pa.int32()) for x in range(4)), pa.array(blobs, pa.binary())], names=["tile", "bucket", "i", "j", "part"])
        release()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []

        def give() -> pa.RecordBatch:
            a, b = pairs_of_tile(held[0], *(np.concatenate(c) for c in zip(*blobs, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for *at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != held and blobs:
                    yield give()
                    blobs = []
                held = at
                blobs.append(pickle.loads(blob))
        if blobs:
            yield give()
        blobs = []
        release()

    dealt = known.select("node", "label", "n", "first", "bits").mapInArrow(deal, "tile int, bucket int, i int, j int, part binary").repartition("tile", "bucket", "i", "j")
    return dealt.sortWithinPartitions("tile", "bucket", "i", "j").mapInArrow(join, "a long, b long").distinct()


def pairs_of_tile(tile: int, nodes, labels, ns, maps, shingle, is_short, counts) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect a tile's classes which share a shingle of their prefixes, are of different components, fit in size, and whose bits allow the overlap."""
    owner = np.repeat(np.arange(len(nodes)), counts)
    order = np.lexsort((labels[owner], shingle))
    shingle, owner, is_short = shingle[order], owner[order], is_short[order]
    label = labels[owner]
    own_band = np.searchsorted(bands(), ns, "right") - 1 == tile
    spare = ns - np.bitwise_count(maps).sum(1, dtype=np.int64)
    new_group = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    new_run = new_group | np.concatenate([[True], label[1:] != label[:-1]])
    at = np.arange(len(owner))
    group, run = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_run, at, 0))
    others = run - group  # members of the group before that are of other components
    which = np.flatnonzero(others)
    total = np.cumsum(others[which])
    root = np.arange(len(nodes))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges: list[tuple[int, int]] = []
    start = 0
    while start < len(which):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE)))
        e = which[start:end]
        n = others[e]
        left = np.repeat(e, n)
        right = np.repeat(group[e], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        start = end
        x, y = owner[left], owner[right]
        smaller = np.where(ns[x] <= ns[y], is_short[left], is_short[right]) | ((ns[x] == ns[y]) & is_short[right])
        ok = smaller & (100 * np.minimum(ns[x], ns[y]) >= PERCENT * np.maximum(ns[x], ns[y])) & (own_band[x] | own_band[y])
        both = np.unique(np.minimum(x, y)[ok] * len(nodes) + np.maximum(x, y)[ok])
        x, y = both // len(nodes), both % len(nodes)
        step = max(1, 4 * PAIRS_AT_ONCE // maps.shape[1])
        for low in range(0, len(x), step):
            p, q = x[low : low + step], y[low : low + step]
            bound = np.bitwise_count(maps[p] & maps[q]).sum(1, dtype=np.int64) + np.minimum(spare[p], spare[q])
            near = (100 + PERCENT) * bound >= PERCENT * (ns[p] + ns[q])
            for i, j in zip(p[near].tolist(), q[near].tolist(), strict=True):
                i, j = top(i), top(j)
                if i != j:
                    root[i] = j
                    edges.append((i, j))
    found = np.array(edges, np.int64).reshape(-1, 2)
    return nodes[found[:, 0]], nodes[found[:, 1]]


def in_blocks(rows: DataFrame, key: list[str], label: str | None = None) -> DataFrame:
    """rows (key, node, n and others) with i, j and second: a key's classes are dealt into blocks of bounded size; each two blocks, and each with itself, meet once. Keys of one class go, or of one label."""
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = rows.groupBy(*key).agg(size.alias("blocks"), F.min(label or "node").alias("low"), F.max(label or "node").alias("high")).where("low <> high").drop("low", "high")
    dealt = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "second": F.col("block") > F.col("other")}).drop("block", "other", "blocks")


def met(rows: DataFrame, key: list[str], columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """kernel(at, first block's rows, second's) for each group of two blocks, at being the key, i and j; a row holds the columns, and the kernel gives the schema's."""
    target = T._parse_datatype_string(schema)
    kinds = [{"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in target.fields]
    names, k = target.names, len(key) + 2
    groups = rows.select(*key, "i", "j", "second", *columns).repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last = None, [], []

        def give() -> pa.RecordBatch:
            found = kernel(at, first, last) if first and (last or at[-1] == at[-2]) else ([],) * len(names)
            return pa.RecordBatch.from_arrays([pa.array(f, kind) for f, kind in zip(found, kinds, strict=True)], names=names)

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:k] != at and at is not None:
                    yield give()
                    first, last = [], []
                at = row[:k]
                (last if row[k] else first).append(row[k + 1 :])
        if at is not None:
            yield give()
        first, last = [], []
        release()

    return groups.mapInArrow(run, schema)


def between_components(at: tuple, first: list, last: list) -> tuple[list, list]:
    """Each label of components that classes (label, set) of a group link, with the smallest that these links reach: a row less than labels, whatever the number of links."""
    rows = first + last
    labels, sets = np.array([r[0] for r in rows], np.int64), [np.frombuffer(r[1], np.uint64) for r in rows]
    x, y = links_within(sets, len(first), at[-1] == at[-2], bits_of(band_of(max(map(len, sets))) + 1), labels)
    a, b = hung(labels[x], labels[y])
    return a[a != b].tolist(), b[a != b].tolist()


def number_of_links(at: tuple, first: list, last: list) -> tuple[list, list]:
    """A component's classes (node, weight, set) and their links in these blocks; a class counts as often as it has documents."""
    rows = first + last
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    x, y = links_within(sets, len(first), at[-1] == at[-2], bits_of(band_of(max(map(len, sets))) + 1))
    weights = np.array([r[1] for r in rows], np.float64)
    links = (np.bincount(x, weights[y], len(rows)) + np.bincount(y, weights[x], len(rows))).astype(np.int64)
    found = np.flatnonzero(links).tolist()
    return [rows[k][0] for k in found], links[found].tolist()


def typed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def labelled_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, node, n), classes, the labels of the classes that have links to others, and sorted arrays of these."""
    frequent = frequent_shingles(docs)
    rows = cut(classes_of(docs))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("one")
    grouped = describe(docs, frequent).where("n > 0").groupBy("node").agg(one, F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.max("keys").alias("keys"), F.max("first").alias("first"), F.max("bits").alias("bits"))
    classes = cut(grouped.select("node", "one.doc_id", "one.row", "weight", "n", "keys", "first", "bits"))
    del grouped  # its files go with it

    by_key = classes.select("node", "n", F.explode("keys").alias("key"))
    pivots = by_key.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("held")).where("held > 1").select(F.col("key").alias("of"), "p")
    near = by_key.join(pivots, F.col("key") == F.col("of")).where(f"node <> p.node AND 100 * least(n, p.n) >= {PERCENT} * greatest(n, p.n)").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    near = cut(near.distinct())
    sets = arrays(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), classes, docs)
    labels = cut(components(cut(verified(near, sets))))

    known = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n", "first", "bits")
    kept = cut(enough_shared(known, frequent))
    groups = cut(components(cut(candidates(cut(known.join(kept, "node"))))))
    sets = sets.unionByName(arrays(groups.select("node").join(sets.select("node"), "node", "left_anti"), classes, docs))
    members = groups.withColumnRenamed("label", "group").join(known.select("node", "label", "n"), "node")
    bridges = cut(met(in_blocks(members, ["group"], "label").join(sets, "node"), ["group"], ["label", "set"], between_components, "a long, b long").distinct())
    if bridges.limit(1).count():  # the components so far are links too, of the shortest kind
        labels = cut(components(bridges.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))
    tidy(docs.sparkSession)
    return rows, classes, labels, sets


def counted_links(classes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """node and n_links of every class: all classes of its component that link with it, by their documents, and its own other documents."""
    members = labels.join(classes.select("node", "n", "weight"), "node")
    found = met(in_blocks(members, ["label"]).join(sets, "node"), ["label"], ["node", "weight", "set"], number_of_links, "node long, links long")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return classes.select("node", "weight").join(links, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def join_documents(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, its own included) and, if asked for, n_links (how many other rows link with it), one row per row of docs."""
    rows, classes, labels, sets = labelled_classes(typed(docs))
    of_class = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = of_class.join(smallest, "label").select("node", "component_id")
    if links:
        placed = placed.join(cut(counted_links(classes, labels, sets)), "node")
    out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    return rows.join(placed, "node", "left").select(*out, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), links=True)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT a AS doc_id, a AS reached FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(l.n_links, 0) AS n_links FROM s LEFT JOIN c ON s.doc_id = c.doc_id LEFT JOIN l ON s.doc_id = l.doc_id
"""

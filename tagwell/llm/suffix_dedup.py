"""Removal of repeated passages by suffix sorting.

A window of `length` bytes that starts at two places of the corpus is found in three steps.
1. Each window has an anchor: of the ANCHOR-byte strings in it, the leftmost of smallest hash. Equal windows have equal anchors
   at equal places, so neighbouring windows of one anchor form a context (the bytes they cover), and only contexts of one anchor can
   share a window. Equal contexts are counted first: where there are two, all their windows are repeated.
2. The different contexts of an anchor, when there are several, go to a block together with those of other anchors. In each block
   the suffixes are put in order by linear grouping (SuffixGroups.java: Lyndon-prefix groups in descending order by
   previous-smaller pointers, then each group's order, without renaming), and windows that neighbours in this order share are repeated.
   An anchor with too many different contexts for a block is dealt out by digests of its windows instead, which are counted.
3. Runs of repeated windows return to all occurrences of their contexts; the bytes they cover are removed.

Many passages of 50 words are shorter than 400 bytes. So the same three steps also find passages of `words` words or more that another document holds, too: windows are of words between
white space, anchors of ANCHOR_WORDS words, and a window counts if its suffix has a neighbour of another text in the order. They are counted for each document and not removed.

The Java source is compiled by Spark's own expression compiler when the session first needs it, and reaches executors as a jar.

Texts with equal digests (128 bits) are one text; contexts are told apart by 128 bits of their anchor and bytes.

Defined results: null and empty texts have no bytes; shorter ones than `length` stay whole; texts of any length are taken whole; repeated rows are texts like others, so long ones
go as a whole, and are one passage; any doc_id may occur, null too; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.llm import files
from tagwell.llm.common import cut, release, shared_dir, sized_partitions, slices, table, tidy
from tagwell.llm.shingle_join import ODD, word_hashes

LENGTH, ANCHOR = 400, 48
WORDS, ANCHOR_WORDS = 50, 8
ALL = (1 << 31) - 1
CHUNK = 1 << 20
BLOCK_BYTES, BLOCK_CONTEXTS = 1 << 20, 4096
FACTOR = 0x9E3779B97F4A7C15
PLACE_BITS = np.uint64((1 << 24) - 1)
FUNCTION, CLASS = "tagwell_repeated_windows", "tagwell.llm.SuffixGroups"
_registered: set[str] = set()


def register(spark: SparkSession) -> None:
    """Compile the Java source, ship it as a jar, and register the function."""
    app = spark.sparkContext.applicationId
    if app in _registered:
        return
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook((Path(__file__).parent / "SuffixGroups.java").read_text())
    found, jar = compiler.getBytecodes(), io.BytesIO()
    with zipfile.ZipFile(jar, "w") as out:
        for name in found.keySet().toArray():
            out.writestr(str(name).replace(".", "/") + ".class", bytes(found.get(name)))
    uri = f"{shared_dir(spark)}/suffix-groups-{uuid.uuid4().hex}.jar"
    files.write_once(uri, jar.getvalue())
    spark.sql(f"ADD JAR '{uri}'")
    instance = compiler.getClassLoader().loadClass(CLASS).newInstance()
    spark._jsparkSession.udf().register(FUNCTION, instance, spark._jsparkSession.parseDataType('"binary"'))
    _registered.add(app)


def pack(strings: list[bytes], window: int = LENGTH, owners: list[int] | None = None) -> bytes:
    return struct.pack(f">{2 + len(strings)}i{len(strings)}q", window, len(strings), *map(len, strings), *(owners or [0] * len(strings))) + b"".join(strings)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 4096
    inverse = pow(FACTOR, -1, 1 << 64)
    return np.cumprod(np.full(size, FACTOR, np.uint64)), np.cumprod(np.full(size, inverse, np.uint64))


def anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each string of `size` bytes, by prefix sums of a polynomial."""
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchored(h: np.ndarray, n: int, width: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n windows, the i-th with the strings i to i + width - 1 of these hashes: the anchor's hash, the first and the last window of each run of one anchor and, if given, one owner."""
    keyed = (h & ~PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    keyed = np.concatenate([keyed, np.full(-len(keyed) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead, behind = np.minimum.accumulate(keyed, 1).ravel(), np.minimum.accumulate(keyed[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & PLACE_BITS).astype(np.int64)
    fresh = at[1:] != at[:-1] if owner is None else (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    return h[at[first]].view(np.int64), first, np.append(first[1:], n) - 1


def contexts(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' hashes, first bytes and ends of the windows that share an anchor, in runs that cover all windows."""
    for base in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - base), base)
        h, first, last = anchored(anchor_hashes(part, anchor), len(part) - length + 1, length - anchor + 1)
        yield h, first + base, last + base + length


def word_contexts(texts: list[bytes], words: int = WORDS, anchor: int = ANCHOR_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for windows of words, of many texts at once, each with one space before and behind each word; before these, which text it is."""
    data = b"".join(texts)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.cumsum([0, *map(len, texts)])
    before = np.searchsorted(space, starts)  # spaces of the texts before each
    width = words - anchor + 1
    w = word_hashes(data)
    if len(w) < words:
        return
    h = w[: len(w) - anchor + 1] * ODD[0]
    for k in range(1, anchor):
        h = (h ^ (h >> np.uint64(31))) * ODD[k % len(ODD)] + w[k : len(w) - anchor + 1 + k]
    h = (h ^ (h >> np.uint64(29))) * ODD[1]
    h ^= h >> np.uint64(32)
    counts = np.diff(before) - 1  # words of each text
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(w))  # words of its text from here on
    for base in range(0, len(w) - words + 1, CHUNK):
        n = min(CHUNK, len(w) - words + 1 - base)
        own, first, last = anchored(h[base : base + n + width - 1], n, width, owner[base : base + n])
        first, last = first + base, last + base
        last = np.minimum(last, first + left[first] - words)  # windows don't reach into the next text
        ok = last >= first
        own, first, last = own[ok], first[ok], last[ok]
        of = owner[first]
        yield of, own, space[first + of] - starts[of], space[last + of + words] + 1 - starts[of]  # each text has a space more than words


def spaced(data: bytes) -> bytes:
    """The words between white space, with one space before and behind each."""
    return b" ".join([b"", *data.split(), b""])


def windows_of(data: bytes, window: int) -> Iterator[tuple[int, int]]:
    """First byte and end of each window."""
    if window > 0:
        yield from ((i, i + window) for i in range(len(data) - window + 1))
    else:
        space = [i for i, c in enumerate(data) if c == 32]
        yield from ((a, b + 1) for a, b in zip(space, space[-window:]))


OCCURRENCE = "h long, ctx long, k1 long, k2 long, start int, size int"


def occurrences(texts: DataFrame, window: int) -> DataFrame:
    """Each context of each text: anchor h, digest ctx, the text's key, first byte and number of bytes."""

    def found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        if window > 0:
            for k, data in enumerate(texts):
                for h, first, end in contexts(data, window):
                    yield np.full(len(h), k), h, first, end
        else:
            yield from word_contexts(texts, -window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            texts = batch.column(2).to_pylist() if window > 0 else [spaced(data) for data in batch.column(2).to_pylist()]
            parts = list(found(texts)) or [(np.empty(0, np.int64),) * 4]
            of, h, first, end = (np.concatenate(c) for c in zip(*parts, strict=True))
            digest = xxhash.xxh3_64_intdigest
            ctx = np.fromiter((digest(texts[k][a:b]) for k, a, b in zip(of.tolist(), first.tolist(), end.tolist(), strict=True)), np.uint64, len(of)) ^ np.uint64(1 << 63)
            columns = (h, ctx.view(np.int64), keys[0][of], keys[1][of], first.astype(np.int32), (end - first).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "ctx", "k1", "k2", "start", "size"])
        release()

    return texts.mapInArrow(run, OCCURRENCE)


def fetched(needed: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """h, ctx, owner and the bytes of contexts, from their text."""
    wanted = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "ctx", "owner", "start", "size")).alias("list")).withColumnsRenamed({"k1": "of1", "k2": "of2"})
    rows = wanted.join(texts, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2"))).select("list", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist() if window > 0 else [spaced(data) for data in part.column(1).to_pylist()]
                out = [(x["h"], x["ctx"], x["owner"], data[x["start"] : x["start"] + x["size"]]) for found, data in zip(part.column(0).to_pylist(), texts, strict=True) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "ctx", "owner", "data"])
        release()

    return rows.mapInArrow(run, "h long, ctx long, owner long, data binary")


def sorted_blocks(strings: DataFrame, blocks: int, window: int) -> DataFrame:
    """h, ctx, first byte and end of what repeated windows cover, by the order of suffixes in each block."""
    dealt = strings.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks))).repartition(min(blocks, 8 * sized_partitions(strings.sparkSession)), "block").sortWithinPartitions("block")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = {}, None

        def give() -> pa.RecordBatch:
            keys = [x for k in held for x in k]
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([pack([v[1] for v in held.values()], window, [v[0] for v in held.values()])], pa.binary())], names=["keys", "blob"])

        for batch in slices(batches):
            for b, h, ctx, owner, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block and held:
                    yield give()
                    held = {}
                block = b
                held[h, ctx] = owner, data  # equal texts bring a context more than once
        if held:
            yield give()
        held = {}
        release()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, runs = np.array(keys, np.int64).reshape(-1, 2), np.frombuffer(runs, ">i4").reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[runs[:, 0], 0]), pa.array(keys[runs[:, 0], 1]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["h", "ctx", "first", "end"])

    blobs = dealt.select("block", "h", "ctx", "owner", "data").mapInArrow(build, "keys array<long>, blob binary")
    return blobs.select("keys", F.expr(f"{FUNCTION}(blob)").alias("runs")).mapInArrow(read, "h long, ctx long, first int, end int")


def counted_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many contexts, by counting digests of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, ctx, owner, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = list(windows_of(data, window))
                n = len(own)
                columns = [pa.array([h] * n, pa.int64()), pa.array([ctx] * n, pa.int64()), pa.array([owner] * n, pa.int64()), pa.array([a for a, _ in own], pa.int32()), pa.array([b for _, b in own], pa.int32()), pa.array([xxhash.xxh3_128_digest(data[a:b]) for a, b in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "ctx", "owner", "first", "end", "window"])

    windows = strings.dropDuplicates(["h", "ctx"]).mapInArrow(run, "h long, ctx long, owner long, first int, end int, window binary")
    counts = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    twice = counts.where("n > 1" if window > 0 else "low <> high").select(F.col("window").alias("of"))
    return windows.join(twice, F.col("window") == F.col("of")).select("h", "ctx", "first", "end")


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2 and spans (first byte, end) that repeated windows cover, for texts (k1, k2, data) that have any. A window above 0 is a number of bytes and repeats anywhere else; below 0 it is a number of words, which another text has to hold, spans are of the spaced text, and one of ALL covers a text that several rows hold."""
    register(texts.sparkSession)
    found = cut(occurrences(texts, window))
    several_texts = F.min(F.struct("k1", "k2")) != F.max(F.struct("k1", "k2"))
    different = found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("one"), several_texts.alias("shared"))
    if window > 0:
        different = different.withColumn("shared", F.col("n") > 1)
    of_anchor = Window.partitionBy("h")
    known = cut(different.withColumn("contexts", F.count(F.lit(1)).over(of_anchor)).withColumn("all", F.sum("n").over(of_anchor)).withColumn("whole", F.min("shared").over(of_anchor)).where("all > 1").select("h", "ctx", "n", "one", "shared", "contexts", "whole"))
    whole = known.where("shared").select("h", "ctx", F.lit(0).alias("first"), F.col("one.size").alias("end"))
    owner = F.when(F.col("shared"), F.xxhash64("h", "ctx")).otherwise(F.xxhash64("one.k1", "one.k2"))
    several = known.where("contexts > 1 AND NOT whole").select("h", "ctx", "contexts", "one.*", owner.alias("owner"))
    few, many = F.col("contexts") <= BLOCK_CONTEXTS, F.col("contexts") > BLOCK_CONTEXTS
    size = several.where(few).agg(F.sum("size")).first()[0] or 0
    marks = whole.unionByName(sorted_blocks(fetched(several.where(few), texts, window), 1 + size // BLOCK_BYTES, window))
    if several.where(many).limit(1).count():
        marks = marks.unionByName(counted_windows(fetched(several.where(many), texts, window), window))
    marks = cut(marks.groupBy("h", "ctx").agg(F.collect_list(F.struct("first", "end")).alias("runs")).withColumnsRenamed({"h": "of", "ctx": "of_ctx"}))
    tidy(texts.sparkSession)
    spans = found.join(marks, (F.col("h") == F.col("of")) & (F.col("ctx") == F.col("of_ctx"))).select("k1", "k2", F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["end"]).alias("end"))).alias("spans"))
    if window < 0:  # each row with a window has one context from the first byte on
        copies = found.where("start = 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        spans = spans.unionByName(copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("first"), F.lit(ALL).alias("end"))).alias("spans")))
    return spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """doc_id, data (the text's bytes), spans (removed runs of bytes) and kept (the other bytes), one row per row of docs; with words, also n_passages: how many passages of so many words or more another document holds, too."""
    digest = F.sha2(F.col("data"), 256)
    word = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("data")).select("doc_id", "data", word(1).alias("k1"), word(16).alias("k2"))
    texts = rows.where(F.octet_length("data") >= length).select("k1", "k2", "data")
    found = cut(repeated_spans(texts, length))
    if words:
        passages = cut(repeated_spans(rows.where(F.octet_length("data") >= 2 * words - 1).select("k1", "k2", "data"), -words))
        found = found.join(passages.withColumnRenamed("spans", "passages"), ["k1", "k2"], "full_outer")
    else:
        found = found.withColumn("passages", F.lit(None).cast("array<struct<first: int, end: int>>"))
    found = found.withColumnsRenamed({"k1": "of1", "k2": "of2"})
    tidy(docs.sparkSession)
    placed = rows.join(found, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")), "left").select("doc_id", "data", "spans", "passages")
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs, kept, passages = [], [], []
            for data, found, others in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                own = joined([(x["first"], x["end"]) for x in found or ()])
                edges = [0, *(x for run in own for x in run), len(data)]
                runs.append([{"first": a, "end": b} for a, b in own])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                passages.append(len(joined([(x["first"], x["end"] - 1) for x in others or ()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, arrow), pa.array(kept, pa.binary()), pa.array(passages, pa.int64())], names=["doc_id", "data", "spans", "kept", "n_passages"])
        release()

    out = placed.mapInArrow(run, "doc_id long, data binary, spans array<struct<first: int, end: int>>, kept binary, n_passages long")
    return out if words else out.drop("n_passages")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("data").cast("long")
    return deduplicate(table(spark, sf_dir, "documents"), words=WORDS).select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages",
    )

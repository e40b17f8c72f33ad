"""Document fingerprints by locally consistent parsing.

A text's code points are parsed level by level. On each level runs of one symbol become a symbol; then
deterministic coin tossing gives each symbol a small label from the lowest bit in which it differs from its
left neighbour, three times over; phrases begin at the labels' local minima, and a phrase's name, a
hash of what it holds, is a symbol of the next level. A phrase's borders depend on a few symbols on either
side only, so equal substrings have equal names inside, wherever they stand.

The fingerprint keeps the SKETCH smallest of a text's distinct names, from the level on whose phrases are words or
more; a text too short for that keeps names of the levels below. Likeness estimates the share of
common names from two fingerprints.

Defined results: null is as empty; the empty text has the empty fingerprint, like itself only; texts of any length are parsed whole; repeated rows are documents each; documents are ordered by
doc_id, descending, null last, equal ids by a hash of the text, then by text; a document alone is its own next; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwell.llm.common import release, sized_partitions, slices, table

PART_BYTES = 1 << 26
SKETCH, BASE_LEVEL, ENOUGH, ROUNDS = 64, 3, 12, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.full(64, 0xBF58476D1CE4E5B9, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= SECOND
    return x ^ (x >> np.uint64(32))


def toss(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels from the lowest bit in which a symbol differs from its left neighbour; head: places without one."""
    diff = np.empty_like(x)
    diff[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
    diff[head] = 1
    low = np.bitwise_count(~diff & (diff - x.dtype.type(1)))
    return (low * np.uint8(2) + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def level_up(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and where each text starts among them, from those of one level; no text is empty."""
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[starts] = True
    if not fresh.all():  # runs
        at = np.flatnonzero(fresh)
        lengths = np.diff(at, append=len(names))
        starts = np.searchsorted(at, starts)
        names = names[at].astype(np.uint64)
        long = lengths > 1
        names[long] = mix(names[long] * MULTIPLIER + lengths[long].astype(np.uint64))
    labels = toss(names, starts)
    for _ in range(ROUNDS - 1):
        labels = toss(labels, starts)
    begins = np.zeros(len(labels), bool)
    begins[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] <= labels[2:])
    begins[starts[1:] - 1] = False  # a text's last symbol joins the phrase before it, and its second one the first
    after = starts + 1
    begins[after[after < len(begins)]] = False
    begins[starts] = True
    at = np.flatnonzero(begins)
    offset = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    up = mix(np.add.reduceat(mix(names.astype(np.uint64)) * POWERS[np.minimum(offset, 63)], at))
    return up, np.searchsorted(at, starts)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Of each text the smallest 32-bit names, ascending."""
    full = [i for i, t in enumerate(texts) if t]
    out = [np.empty(0, np.uint32)] * len(texts)
    if not full:
        return out
    names = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in full])[:-1]])
    levels = [(names, starts)]
    while len(levels[-1][0]) > len(full):  # each level is shorter
        levels.append(level_up(*levels[-1]))
    hashed = [(mix(x.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) for x, _ in levels]
    ends = [np.append(s[1:], len(x)) for x, s in levels]
    for j, i in enumerate(full):
        of_level = lambda k: hashed[k][levels[k][1][j] : ends[k][j]]  # noqa: B023, E731
        top = next(k for k in range(len(levels)) if ends[k][j] - levels[k][1][j] == 1)
        k = min(BASE_LEVEL, top)
        parts = [of_level(up) for up in range(k, top + 1)]
        while sum(map(len, parts)) < ENOUGH and k > 0:
            k -= 1
            parts.append(of_level(k))
        out[i] = np.unique(np.concatenate(parts))[:SKETCH]
    return out


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~same])
    size = int(min(distinct.sum(), max(len(a), len(b))))
    bound = both[distinct][size - 1]
    return float((both[:-1][same] <= bound).sum() / size)


def likeness_of_strings(a: str, b: str) -> float:
    return likeness(*(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (a, b)))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt by descending doc_id, a partition of about PART_BYTES after the other, each ending with a copy of the next one's first row (`tail`).

    Ids that many rows share, and rows without one, are dealt further by hash. Cut points and the keys of first rows, one for each partition, are all that the driver gets.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 11))
    size, rows, nulls = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    n = max(sized_partitions(spark), 1 + (size or 0) // PART_BYTES)
    found = [int(c) for c in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)] if n > 1 and rows > nulls else []
    cuts = sorted(set(found))
    often = {c: found.count(c) for c in cuts if found.count(c) > 1}  # ids that hold about so many partitions
    ranges = 2 * len(cuts) + 3  # an often held id's stands before that of the ids between it and the next cut point; the last one is of rows without id
    widths = [1] * (ranges - 1) + [max(1, -(-nulls * n // max(1, rows)))]
    above = lambda x: sum(c >= x for c in cuts)
    for c, times in often.items():
        widths[2 * above(c)] = times
    offsets = [sum(widths[:k]) for k in range(ranges)]
    array = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    higher = F.size(F.filter(array(cuts), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    own = F.array_contains(array(often), F.col("doc_id")) if often else F.lit(False)
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(ranges - 1)).otherwise(2 * higher + F.when(own, 0).otherwise(1)).cast("int"))
    within = F.floor(F.col("hash") / F.lit(float(1 << 53)) * F.element_at(array(widths), F.col("range") + 1))
    placed = placed.withColumn("place", (F.element_at(array(offsets), F.col("range") + 1) + within).cast("int")).drop("range")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), (-F.col("doc_id")).alias("down"), "hash")).alias("first")
    heads = sorted((r.place, None if r.first.unknown else -r.first.down, r.first.hash) for r in placed.groupBy("place").agg(first).collect())
    following = [(p, *heads[(i + 1) % len(heads)][1:]) for i, (p, _, _) in enumerate(heads)]
    wanted = spark.createDataFrame(following, "tail_place int, head long, head_hash long")
    tails = (
        docs.join(F.broadcast(wanted), docs["doc_id"].eqNullSafe(wanted["head"]) & (docs["hash"] == wanted["head_hash"])).groupBy("tail_place").agg(F.min(F.struct("doc_id", "text", "hash")).alias("row"))
        .select("row.doc_id", "row.text", "row.hash", F.col("tail_place").alias("place"), F.lit(True).alias("tail"))
    )
    rows = placed.withColumn("tail", F.lit(False)).unionByName(tails)
    return rows.repartitionById(sum(widths), F.col("place")).sortWithinPartitions("place", "tail", F.col("doc_id").desc_nulls_last(), "hash", "text")


def fingerprint_documents(docs: DataFrame, batch_chars: int = 1 << 20) -> DataFrame:
    """Of each document the fingerprint, that of its edited text, and their likeness, and that to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= batch_chars and len(held) > 1:
                    yield out(held)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield out(held)
        held.clear()
        release()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        """Of all but the last row, and not of tails."""
        texts = [r[1] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        found = sketches(texts + changed)
        own, new = found[: len(texts)], found[len(texts) :]
        keep = [i for i in range(len(rows) - 1) if not rows[i][3]]
        columns = [
            pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in keep], pa.string()),
            pa.array([to_string(own[i]) for i in keep], pa.string()), pa.array([to_string(new[i]) for i in keep], pa.string()),
            pa.array([likeness(own[i], new[i]) for i in keep], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in keep], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return with_next(docs).select("doc_id", "text", "place", "tail").mapInArrow(run, SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
